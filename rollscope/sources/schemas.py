"""Schemas of the tables; CSV has strings only."""

from pyspark.sql.types import StringType, StructField, StructType


def strings(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


ROLL = strings("elector_name", "father_or_husband_name", "sex", "state")
ROLL_NAMED = strings("name", "father_or_husband_name", "sex", "state")
ROLL_T13N = strings("elector_name_t13n", "father_or_husband_name_t13n", "state", "sex")
ROLL_DELHI = strings("name", "father's name", "husband's name")
STATE_LANGUAGES = strings(
    "state", "official_languages", "addl_official_languages", "most_spoken_lang", "second_most_spoken_lang",
    "third_most_spoken_lang", "fourth_most_spoken_lang", "fifth_most_spoken_lang",
)
