"""Markdown stripping and text truncation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscore.functions.columns import substitute

# Whitespace in the sense of Unicode text processing: Java's (?U)\s plus the
# four ASCII separators that it leaves out.
WS = r"[\s\x1c-\x1f]"
WS_IN_LINE = r"[\s\x1c-\x1f&&[^\n]]"

# The ordered substitutions (pattern, replacement). Order is the
# meaning; (?d) ends lines at \n only, (?U) makes classes Unicode, (?m) anchors
# at every line. Neighbouring rules that all need one of a few marks stand in
# one group under those marks: a text without them skips the group.
STRIP_GROUPS: tuple[tuple[tuple[str, ...], tuple[tuple[str, str], ...]], ...] = (
    # headings
    (("#",), ((rf"(?dUm)^#+{WS}+", ""),)),
    # emphasis
    (
        ("*", "_"),
        (
            (r"\*\*([^*]+)\*\*", "$1"),
            (r"__([^_]+)__", "$1"),
            (r"\*([^*]+)\*", "$1"),
            (r"_([^_]+)_", "$1"),
        ),
    ),
    # strike-through and code marks, links
    (("~", "`"), ((r"[~`]", ""),)),
    (("](",), ((r"\[([^\]]+)\]\([^\)]+\)", "$1"),)),
    # bullets, numbers, quotes, rules
    (
        (),
        (
            (rf"(?dUm)^{WS}*[-*]{WS}+", ""),
            (rf"(?dUm)^{WS}*\d+\.{WS}+", ""),
        ),
    ),
    ((">",), ((rf"(?dUm)^{WS}*>{WS}+", ""),)),
    (("-", "*", "_"), ((rf"(?dUm)^{WS}*[-*_]{{3,}}{WS}*$", ""),)),
    # tables
    (
        ("|", "<br>"),
        (
            (rf"(?dUm)^{WS}*\|[-:|\s\x1c-\x1f]+\|{WS}*$", ""),
            (r"<br>", " "),
            (rf"(?dUm)^{WS}*\|{WS_IN_LINE}*(.*?){WS_IN_LINE}*\|{WS}*$", "$1"),
            (r"\|", " "),
        ),
    ),
    ((), ((rf"(?U){WS}{{2,}}", " "),)),
    # formulas, LaTeX commands
    (("$",), ((r"(?s)\$\$.*?\$\$", ""), (r"\$[^$]+\$", ""))),
    (
        ("\\",),
        (
            (r"(?d)\\\(.*?\\\)", ""),
            (r"(?d)\\\[.*?\\\]", ""),
            (r"\\mathrm\{[^}]+\}", ""),
            (r"\\text\{[^}]+\}", ""),
            (r"\\frac\{[^}]+\}\{[^}]+\}", ""),
            (r"\\sqrt\{[^}]+\}", ""),
            (r"\\sum", ""),
            (r"\\int", ""),
            (r"\\infty", ""),
            (
                r"\\(?:alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi"
                r"|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega)",
                "",
            ),
            (r"\\(?:Gamma|Delta|Theta|Lambda|Xi|Pi|Sigma|Phi|Psi|Omega)", ""),
            (r"\\[a-zA-Z]+", ""),
        ),
    ),
    # entities, escapes, symbols
    (("&",), ((r"&[a-zA-Z]+;", ""),)),
    (("\\",), ((r"(?s)\\[^a-zA-Z]", ""),)),
    ((), ((r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", " "),)),
    # page numbers, contents heading
    ((), ((rf"(?dUm)^{WS}*\d+{WS}*$", ""),)),
    (("Table of Contents",), ((rf"(?dUm)^{WS}*Table of Contents{WS}*$", ""),)),
    # white space
    ((), ((rf"(?U){WS}+", " "),)),
)

# Fixed value: the length to which texts were cut before ROUGE in the
# compatible mode.
ROUGE_MAX_CHARS = 10_000


def strip_markdown(text: Column | str) -> Column:
    """Plain text of a Markdown column: the ordered rules, then trimmed."""
    return F.trim(substitute(F.col(text) if isinstance(text, str) else text, STRIP_GROUPS))


def maybe_strip(text: Column | str, strip: bool = True) -> Column:
    """The stripped text or the text as it is; chosen when the plan is built."""
    return strip_markdown(text) if strip else (F.col(text) if isinstance(text, str) else text)


def mode_label(strip: bool) -> str:
    """Name of the two evaluation modes in metric tables."""
    return "stripped" if strip else "with Markdown"


def truncate_for_rouge(text: Column | str, max_chars: int | None = ROUGE_MAX_CHARS) -> Column:
    """First ``max_chars`` code points; ``None`` keeps the whole text."""
    col = F.col(text) if isinstance(text, str) else text
    return col if max_chars is None else F.substring(col, 1, max_chars)
