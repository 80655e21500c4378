"""Values the results depend on.

Everything in this file is a fixed value of the data model (label maps, thresholds, band
edges, column lists, model settings). The operators take them as defaults of parameters.
"""

# Outcome labels: code 1 = passed, 0 = not passed; any other label has no code.
RESULT_CODES = {"Pass": 1, "Distinction": 1, "Fail": 0, "Withdrawn": 0}
PASSING = ["Pass", "Distinction"]
AT_RISK = ["Fail", "Withdrawn"]
RESULT_ORDER = ["Distinction", "Pass", "Fail", "Withdrawn"]
RESULT_COLUMNS = ["Distinction", "Fail", "Pass", "Withdrawn"]

# Relative days (0 = course start).
DAY_CUTOFFS = (30, 60, 100)
EARLY_DAY = 30
NEVER_WITHDREW = 999

# Columns that get a sorted-rank code.
CATEGORIES = [
    "gender", "region", "highest_education", "imd_band",
    "age_band", "disability", "code_module", "code_presentation",
]

# Model features beside the eight codes, in order.
MEASURES = [
    "total_clicks", "active_days", "clicks_day30", "clicks_day60", "clicks_day100",
    "click_std", "unique_activity_types", "last_active_day",
    "avg_assessment_score", "score_std", "num_assessments_submitted",
    "tma_avg_score", "exam_avg_score", "late_submissions",
    "num_modules_registered", "withdrawal_day", "early_withdraw",
    "studied_credits", "num_of_prev_attempts",
]

# The shorter feature list of the interactive models.
FORM_FEATURES = [
    "avg_assessment_score", "clicks_day30", "active_days", "total_clicks",
    "studied_credits", "num_of_prev_attempts", "tma_avg_score",
    "exam_avg_score", "late_submissions", "click_std",
]

# Mean scores per assessment type: output column -> type.
SCORE_KINDS = {"tma_avg_score": "TMA", "exam_avg_score": "Exam"}

# Deprivation bands, most to least deprived.
IMD_ORDER = [
    "0-10%", "10-20%", "20-30%", "30-40%", "40-50%",
    "50-60%", "60-70%", "70-80%", "80-90%", "90-100%",
]

# Right-closed bands: edges and labels.
ENGAGEMENT_EDGES = [0, 200, 500, 1000, 2000, 999999]
ENGAGEMENT_LABELS = [
    "Very Low (0-200)", "Low (200-500)", "Medium (500-1000)",
    "High (1000-2000)", "Very High (2000+)",
]
WITHDRAWAL_EDGES = [0, 30, 60, 100, 200, 999]
WITHDRAWAL_LABELS = ["0-30 days", "31-60 days", "61-100 days", "101-200 days", "200+ days"]
LATE_EDGES = [0, 1, 3, 5, 20]

# Risk flag limits.
RISK_CLICKS = 200
RISK_SCORE = 50

# Split, folds, sampling.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
PLOT_ROWS = 2000
DEMO_STUDENTS = 5000

# Columns of the day-30 risk report.
RISK_REPORT_COLUMNS = [
    "id_student", "gender", "age_band", "highest_education", "imd_band", "code_module",
    "clicks_day30", "active_days", "avg_assessment_score", "final_result", "target",
]

# Columns shown first by the data explorer.
EXPLORER_COLUMNS = [
    "gender", "age_band", "highest_education", "final_result",
    "total_clicks", "avg_assessment_score", "active_days",
]

# Text that a CSV cell may hold in place of a value.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
