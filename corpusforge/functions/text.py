"""Column expressions over text: tokens, sentences, hashing, display names.

All are built-in Spark expressions (JVM side, no Python in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.rules import HASH_SEP, SENTENCE_RE, TOKEN_RE, TOKEN_RE_FAST


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text, fast: bool = False) -> Column:
    """T01 front half: text -> array of token strings under the declared rule."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_RE_FAST if fast else TOKEN_RE), F.lit(0))


HEAD_SPAN_MAX = 1024


def head_span_re(k: int, fast: bool = False) -> str:
    """Anchored pattern matching exactly the span of the first ``k`` tokens.

    Between tokens only whitespace can occur (every other character is a
    token), and possessive quantifiers never give back characters, so the
    span holds the same first k tokens as the full extraction. The count is
    possessive too: Java then goes round in a loop, where a greedy one recurses
    once per token and runs out of stack at a thousand or so."""
    tok = r"[^ \t\n\r]++" if fast else r"[\p{L}\p{M}\p{N}]++|[^\p{L}\p{M}\p{N}\s]"
    gap = r"[ \t\n\r]*+" if fast else r"\s*+"
    return rf"^(?:{gap}(?:{tok})){{0,{k}}}+"


def tokens_head(text, k: int, fast: bool = False) -> Column:
    """The first ``k`` tokens, tokenizing only their span (O(k), not O(text)).

    Java regex recurses once per repetition of a group, so large ``k`` falls
    back to the full extraction."""
    if k > HEAD_SPAN_MAX:
        return F.slice(tokens(text, fast), 1, k)
    span = F.regexp_extract(_c(text), head_span_re(k, fast), 0)
    return F.regexp_extract_all(span, F.lit(TOKEN_RE_FAST if fast else TOKEN_RE), F.lit(0))


def token_count(text, specials: int = 0, fast: bool = False) -> Column:
    """Encoded length; ``specials=2`` for the whole-document test."""
    return F.size(tokens(text, fast)) + F.lit(specials)


def sentences(text) -> Column:
    """Document -> array of sentences (rule-based)."""
    return F.regexp_extract_all(_c(text), F.lit(SENTENCE_RE), F.lit(0))


def sentences_head(text, k: int) -> Column:
    """The first ``k`` sentences, reading only their span: what lies between two sentences are end marks and white space."""
    span = F.regexp_extract(_c(text), rf"^(?:[.!?\s]*+[^.!?\s][^.!?\n]*+[.!?]*+){{0,{k}}}", 0)
    return F.regexp_extract_all(span, F.lit(SENTENCE_RE), F.lit(0))


def seeded_hash(key, seed) -> Column:
    """md5 hex of ``key#seed`` — the shared order key for every seeded op."""
    return F.md5(F.concat_ws(HASH_SEP, _c(key).cast("string"), F.lit(str(seed))))


def lang_display(col) -> Column:
    """Underscores to spaces, then title case (capital after any non-letter)."""
    s = F.regexp_replace(_c(col), "_", " ")
    # Python title(): upper after a non-letter, lower after a letter.
    parts = F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))),
        "",
    )


def strip_newlines(col) -> Column:
    """Delete newlines, no space put in."""
    return F.regexp_replace(_c(col), "\n", "")


def truncate_tokens(text, budget: int, fast: bool = False) -> Column:
    """Keep the first ``budget`` tokens and render them back (space-joined)."""
    return F.array_join(tokens_head(text, budget, fast), " ")
