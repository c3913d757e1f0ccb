"""Column-level text functions (native Spark expressions, no Python per row)."""

from threadlens.functions.text import (  # noqa: F401
    BLACKLIST, STOP_WORDS, clean_line, ngrams, strip_punctuation, tokens, tokens_alpha,
    tokens_freq, tokens_plain, unescape_html,
)
from threadlens.functions.stem import stem  # noqa: F401
