"""Fixed values that results depend on.

These strings are part of the observable behaviour of a claim-verification run
(labels, sentinels, placeholder texts, file naming), so they are stated here
plainly and in one place.
"""

# ---- fixed values: label domains -------------------------------------------
FEVER_LABELS = ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO"]
PUBHEALTH_LABELS = ["TRUE", "FALSE", "UNPROVEN", "MIXTURE"]
DEFAULT_JSONL_LABEL = "NOT ENOUGH INFO"

# ---- fixed values: sentinels -----------------------------------------------
ERROR = "ERROR"          # the scorer raised
UNKNOWN = "UNKNOWN"      # lenient extraction found no label
NO_LABEL = "NO_LABEL"    # strict extraction found no label

# ---- fixed values: label patterns (around the alternation of a domain's labels) ----
LENIENT_PATTERN = r"(ANSWER[:：]?)?\s*({labels})"   # group 2, any case; the prefix changes nothing
STRICT_PATTERN = r"\b({labels})\b"                # group 1, of the upper-cased text

# ---- fixed values: evidence placeholders -----------------------------------
NO_EVIDENCE = "[No evidence provided]"
PAGE_NOT_FOUND_PREFIX = "[Page not found: "
SENTENCE_NOT_FOUND_PREFIX = "[Sentence index "
SENTENCE_NOT_FOUND_MIDDLE = " not found in "
PLACEHOLDER_SUFFIX = "]"
NULL_TITLE_TEXT = "None"

# ---- fixed values: result-file layout --------------------------------------
RESULT_COLUMNS = ["Claim", "Evidence", "True_Label", "Predicted_Label"]
RAW_OUTPUT_COLUMN = "Raw_Output"
RESULT_FILE_NAME = "{name}_result_{batch}.csv"
RESULT_FILE_GLOB = "*_result_*.csv"
RESULT_FILE_NUMBER = r"_result_([0-9]+)\.csv$"

# ---- fixed values: per-claim evidence resolution status --------------------
RES_NO_EVIDENCE = "no_evidence"
RES_NO_USABLE = "no_usable_refs"
RES_PAGE_MISS = "page_miss"
RES_SENTENCE_MISS = "sentence_miss"
RES_RESOLVED = "resolved"

# ---- fixed values: report row kinds ----------------------------------------
KIND_CLASS = "class"
KIND_ACCURACY = "accuracy"
KIND_MICRO = "micro avg"
KIND_MACRO = "macro avg"
KIND_WEIGHTED = "weighted avg"
