"""Questions to try retrieval with, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The questions, in their order.
QUESTIONS = (
    "What was the company's revenue from operations in Fiscal 2025?",
    "Who are the promoters of the company?",
    "Who is the Chief Financial Officer of the company?",
    "What is the size of the Fresh Issue?",
    "What were the company's total assets as at March 31, 2025?",
    "What are the objects of the Offer?",
    "What does the prospectus say about the company's manufacturing operations?",
)
PARAPHRASES = {
    "fresh_issue": (
        "What is the size of the Fresh Issue?",
        "What is the Fresh Issue amount?",
        "What amount does the Fresh Issue aggregate to?",
        "What is the amount of the Fresh Issue?",
    ),
    "total_assets": (
        "What were the company's total assets as at March 31, 2025?",
        "What is the company's total assets as at March 31, 2025?",
        "What is the total assets value for March 31, 2025?",
        "What is the total assets amount for March 31, 2025?",
    ),
    "manufacturing_operations": (
        "What does the prospectus say about the company's manufacturing operations?",
        "Which manufacturing facilities does the company operate?",
        "What are the company's manufacturing facilities and capacities?",
        "What are the company's manufacturing operations and capacity utilisation?",
    ),
}
#: Places of the questions that dense retrieval alone is tried with.
DENSE = (0, 1, 2, 4, 5)


def questions(spark: SparkSession, *, dense: bool = False) -> DataFrame:
    """``query_id, query``."""
    places = DENSE if dense else range(len(QUESTIONS))
    return spark.createDataFrame([(k, QUESTIONS[k]) for k in places], "query_id long, query string")


def paraphrases(spark: SparkSession) -> DataFrame:
    """``case_id, query_id, query`` for the diagnostics of wording."""
    return spark.createDataFrame([(case, f"{case}_{k}", q) for case, asked in PARAPHRASES.items() for k, q in enumerate(asked, 1)], "case_id string, query_id string, query string")
