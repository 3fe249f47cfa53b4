"""Declared rules and fixed values used everywhere.

The token and sentence rules are our own (pretrained subword vocabularies
are not available offline); they are written so that Java regex (Spark)
and RE2 (the DuckDB oracle) split identically.
"""

# ---------------------------------------------------------------------------
# Our own rules (declared once)
# ---------------------------------------------------------------------------

# Word rule: a run of letters/marks/digits, or one other non-space character.
TOKEN_RE = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"
# Fast rule: runs of non-blank characters.
TOKEN_RE_FAST = r"[^ \t\n\r]+"
# Sentence rule: starts at a non-blank, runs to the end mark(s) or a newline.
SENTENCE_RE = r"[^.!?\s][^.!?\n]*[.!?]*"

# Special tokens and their ids (ids 0..4; ordinary tokens start at 5).
SPECIALS = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]
BOS_ID, PAD_ID, EOS_ID, UNK_ID, MASK_ID = 0, 1, 2, 3, 4
N_SPECIALS = len(SPECIALS)
VOCAB_MULTIPLE = 64
IGNORE_INDEX = -100

# Hash-order helper: every seeded order is md5(key || '#' || seed).
HASH_SEP = "#"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results
# ---------------------------------------------------------------------------

# Aligned-corpus manifest: subsets x splits; train .id files have three columns.
ALIGNED_SUBSETS = ["ban-msa", "eng-jav", "eng-msa", "eng-sun", "jav-msa", "msa-msa"]
ALIGNED_SPLITS = ["dev", "test", "train"]

# Provenance names.
SOURCE_ALIGNED_PREFIX = "tatoeba-"
SOURCE_WIDE = "nusax-mt"
SOURCE_LEXICON = "nusax-lexicon"
LEXICON_PIVOT_COLUMN = "indonesian"

# Language codes of the aligned corpus and their names; pairs with other codes are left out.
ALIGNED_LANGS = {
    "ban": "balinese",
    "ind": "indonesian",
    "bjn": "banjarese",
    "min": "minangkabau",
    "jav": "javanese",
    "sun": "sundanese",
    "max_Latn": "north maluku malay",
    "zlm_Latn": "malaysian malay",
    "zsm_Latn": "malaysian malay",
    "msa_Latn": "indonesian malay",
    "eng": "english",
}

# Label dictionaries.
SENTIMENT_LABELS = {"negative": 0, "neutral": 1, "positive": 2}
NLI_LABELS = {"entailment": 0, "neutral": 1, "contradiction": 2}

# Chunking: limit counts the two specials on the whole-document test.
CHUNK_MAX_TOKENS = 512

# Sequence lengths and truncation budgets.
MLM_LENGTH = 512
CLASSIFIER_LENGTH = 256
BUDGET_SLACK_INSTRUCTION = 80   # budget = (block - 80) // 2
BUDGET_SLACK_CHAT = 30          # budget = (block - 30) // 2
BUDGET_SLACK_SECTIONS = 100     # budget = (block - 100) // 2

# Masked LM: 15 % of positions; of those 80 % mask, 10 % random, 10 % keep.
MLM_COPIES = 7

# Split, shuffle, schedule settings.
TEST_SHARE = 0.05
SEED = 42
WARMUP_SHARE = 0.1
CHAT_TRIM_CHARS = 2

# Chat markup (one message = start marker, role, newline, content, end marker, newline).
CHAT_START = "<|im_start|>"
CHAT_END = "<|im_end|>"
