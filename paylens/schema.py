"""Column names, types, ordered categories and the null rule of the survey table."""

from __future__ import annotations

from pyspark.sql import types as T

# The 21 text columns of a raw response, in file order.
RAW_COLUMNS = [
    "id",
    "Job Satisfaction",
    "Salary",
    "Salary Unit",
    "Location",
    "Job Title",
    "Firm Type",
    "Firm Size",
    "Health Insurance",
    "Overtime",
    "Vacation Days",
    "Annual Bonus",
    "Work Status",
    "Years of Experience",
    "Age",
    "Gender",
    "Licensed",
    "Undergraduate School",
    "Graduate School",
    "Post-Graduate School",
    "Date",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

SCHOOL_COLUMNS = ["Undergraduate School", "Graduate School", "Post-Graduate School"]

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("Job Satisfaction", T.IntegerType()),
        T.StructField("Salary", T.LongType()),
        T.StructField("Salary Unit", T.StringType()),
        T.StructField("Location", T.StringType()),
        T.StructField("Job Title", T.StringType()),
        T.StructField("Firm Type", T.StringType()),
        T.StructField("Firm Size", T.StringType()),
        T.StructField("Health Insurance", T.StringType()),
        T.StructField("Overtime", T.StringType()),
        T.StructField("Vacation Days", T.DoubleType()),
        T.StructField("Annual Bonus", T.DoubleType()),
        T.StructField("Work Status", T.StringType()),
        T.StructField("Years of Experience", T.StringType()),
        T.StructField("Age", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Licensed", T.StringType()),
        T.StructField("Undergraduate School", T.StringType()),
        T.StructField("Graduate School", T.StringType()),
        T.StructField("Post-Graduate School", T.StringType()),
        T.StructField("Date", T.DateType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("CPIAUCSL", T.DoubleType()),
        T.StructField("Inflation Adjusted Salary", T.DoubleType()),
    ]
)

COORDINATES_SCHEMA = T.StructType(
    [
        T.StructField("Location", T.StringType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
    ]
)

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Texts that stand for a missing value when a text file is read.
NULL_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Category orders for sorting and for pivot columns.
CATEGORY_ORDER = {
    "Firm Size": ["1", "2-5", "6-10", "11-15", "16-30", "31-50", "51-100", "101-200", "201-500", "501+"],
    "Firm Type": ["Boutique", "Corporate", "Individual", "Starchitect", "Other", "N/A"],
    "Age": [
        "18-20", "21-25", "26-30", "31-35", "36-40", "41-45",
        "46-50", "51-55", "56-60", "61-65", "66-70", "71-103",
    ],
    "Years of Experience": [
        "< 1", "1", "2", "3", "3-5", "6-7", "8-10",
        "11-15", "16-20", "21-25", "26-30", "31-40", "> 40",
    ],
    "Licensed": ["Yes", "No"],
    "Gender": ["Female", "Male", "Other"],
}

# Years that stand for each experience label.
EXPERIENCE_MIDPOINTS = {
    "< 1": 0.5,
    "1": 1.0,
    "2": 2.0,
    "3": 3.0,
    "3-5": 4.0,
    "6-7": 6.5,
    "8-10": 9.0,
    "11-15": 13.0,
    "16-20": 18.0,
    "21-25": 23.0,
    "26-30": 28.0,
    "31-40": 35.5,
    "> 40": 40.0,
}
