"""Fixed parameters of the query catalogue, shared by the Spark queries and the oracle SQL."""

import datetime as dt

RANGE_FROM, RANGE_TO = "2024-01-05", "2024-01-12"
INSTANT_FROM, INSTANT_TO = "2024-01-03T06:00:00Z", "2024-01-09T18:30:00.500Z"
EXPORT_FROM, EXPORT_TO = "2024-01-01", "2024-01-30"
RECENT_N = 20
ASSIGN_HWM = 1000
PURGED_AT = dt.datetime(2024, 6, 1, 12, 0, 0)
ANCHOR = dt.date(2024, 1, 1)
INTERVAL_DAYS, MAJOR_EVERY = 7, 4
# Phrase families for the invented multilingual text (the rules' own phrases are
# the defaults in feedloom.functions.routing).
TEXT_SIGNALS = {
    "explicit_negation": ["nicht", " not ", " pas "],
    "missing_requirement": ["ohne", "sans", "without"],
    "replacement_correction": ["should", "soll", "doit"],
    "failed_result": ["error", "Fehler", "erreur"],
    "boundary_correction": ["only", " nur ", "seulement"],
}
