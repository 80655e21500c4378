"""Declared schemas of the seven input tables (fixed values of the data model)."""

from pyspark.sql.types import DoubleType, LongType, StringType, StructType

_TYPES = {"string": StringType(), "bigint": LongType(), "double": DoubleType()}

# Large tables of codes and numbers, whose cells hold no line breaks.
LOGS = ("studentVle", "studentAssessment")

_COLUMNS = {
    "courses": "code_module string, code_presentation string, module_presentation_length bigint",
    "assessments": (
        "code_module string, code_presentation string, id_assessment bigint, "
        "assessment_type string, date bigint, weight double"
    ),
    "vle": (
        "id_site bigint, code_module string, code_presentation string, activity_type string, "
        "week_from bigint, week_to bigint"
    ),
    "studentInfo": (
        "code_module string, code_presentation string, id_student bigint, gender string, "
        "region string, highest_education string, imd_band string, age_band string, "
        "num_of_prev_attempts bigint, studied_credits bigint, disability string, final_result string"
    ),
    "studentRegistration": (
        "code_module string, code_presentation string, id_student bigint, "
        "date_registration string, date_unregistration string"
    ),
    "studentAssessment": (
        "id_assessment bigint, id_student bigint, date_submitted bigint, is_banked bigint, score double"
    ),
    "studentVle": (
        "code_module string, code_presentation string, id_student bigint, id_site bigint, "
        "date bigint, sum_click bigint"
    ),
}


def _schema(columns: str) -> StructType:
    # StructType.fromDDL needs a running session, and this module is imported before there is one
    made = StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        made.add(name, _TYPES[kind])
    return made


SCHEMAS: dict[str, StructType] = {name: _schema(columns) for name, columns in _COLUMNS.items()}
