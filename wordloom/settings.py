"""Fixed values that decide results.  They are data, not tuning knobs."""

# --- fixed values -----------------------------------------------------------------
# Names of the four news classes; the label id is the position.
LABEL_NAMES = ["World", "Sports", "Business", "Sci/Tech"]

# Special vocabulary entries and their ids.
PAD_TOKEN = "<pad>"
UNK_TOKEN = "<unk>"
PAD_IDX = 0
UNK_IDX = 1

# One token: a word with at most one inner apostrophe group, or a number with an
# optional decimal part.  \p{Nd} because plain \d is ASCII-only in Java and RE2.
TOKEN_PATTERN = r"[A-Za-z]+(?:'[A-Za-z]+)?|\p{Nd}+(?:\.\p{Nd}+)?"

# Spellings that the usual CSV reader of the Python world decodes as missing.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Columns a labelled CSV file must have.
CSV_COLUMNS = ["Class Index", "Title", "Description"]

# Defaults of the prepared data set and of training.
VAL_SIZE = 0.1
MAX_VOCAB_SIZE = 50_000
MIN_FREQ = 2
MAX_LEN = 96
BATCH_SIZE = 128
EPOCHS = 8
PATIENCE = 3
SEED = 42

# Word vectors: width, standard deviation of generated rows, training defaults.
VECTOR_DIM = 100
GENERATED_STD = 0.05
W2V_WINDOW = 5
W2V_MIN_COUNT = 5
W2V_NEGATIVE = 10
W2V_EPOCHS = 5
W2V_PARTITIONS = 4

# Norm layers.
RMS_EPS = 1e-8
LAYER_EPS = 1e-5

# Hidden layers of the feed-forward classifier.
MLP_HIDDEN = [256, 128]
# --- end of fixed values ------------------------------------------------------------
