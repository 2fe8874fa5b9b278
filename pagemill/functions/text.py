"""Text functions as columns: everything here stays in the JVM.

Character classes are written out, so that the same patterns mean the same in every engine that is used to check them.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "[ \\t\\n\\r\\f\\x0B\\x{A0}\\x{3000}]"
HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]"
DOMAIN_ACCOUNT = "([A-Za-z]{2,}\\\\[A-Za-z])[0-9]{4,6}([^0-9]|$)"
EMAIL_ID = "(^|[^A-Za-z0-9.])([A-Za-z]{1,3})[0-9]{4,6}@"
NUMBER = "[0-9]+(?:[.,/:-][0-9]+)*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_text(c: Column | str) -> Column:
    """Without comments, tags and named entities, white space collapsed."""
    x = F.regexp_replace(col(c), "(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, "<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(x), f"{SPACE}+", " "))


@F.arrow_udf(T.StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    held = pc.match_substring(texts, "&").fill_null(False)
    if not pc.any(held).as_py():
        return texts
    # only the texts with an ampersand are touched
    return pc.replace_with_mask(texts, held, pa.array([html.unescape(x) for x in texts.filter(held).to_pylist()], pa.string()))


def decode_entities(c: Column | str) -> Column:
    """Named, decimal and hexadecimal entities, each once (what they give isn't decoded again); a no-break space becomes a space."""
    return F.translate(_unescaped(col(c)), "\u00a0", " ")


def normalized_text(c: Column | str) -> Column:
    """Letters, digits and underscores only, in lower case (sharp s stays, where case folding would double it)."""
    return F.lower(F.regexp_replace(col(c), "[^\\p{L}\\p{N}_]", ""))


def compact(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"{SPACE}+", "")


def coverage_form(c: Column | str) -> Column:
    """Without white space and backslashes."""
    return F.regexp_replace(col(c), "[ \\t\\n\\r\\f\\x0B\\x{A0}\\x{3000}\\\\]+", "")


def fullwidth_fold(c: Column | str) -> Column:
    """Full-width digits, percent sign, full stop and comma to ASCII."""
    return F.translate(col(c), "０１２３４５６７８９％．，", "0123456789%.,")


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def numbers(c: Column | str) -> Column:
    """Distinct numbers of a text (array, sorted), full-width digits folded."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fullwidth_fold(c), F.lit(f"({NUMBER})"), F.lit(1))))


def slug(c: Column | str) -> Column:
    x = F.regexp_replace(F.lower(col(c)), "[^a-z0-9\\x{3400}-\\x{9FFF}]+", "-")
    return F.regexp_replace(x, "^-+|-+$", "")


def heading_key(c: Column | str) -> Column:
    """A heading without marks, section sign, white space and punctuation, in lower case."""
    x = F.regexp_replace(col(c), "^#+[ ]*(?:§[ ]*[0-9]+)?", "")
    return F.lower(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", ""))


def markdown_to_text(c: Column | str) -> Column:
    """Markdown to plain text: fences before inline code, images before links."""
    x = col(c)
    for pattern, to in (
        ("(?s)```[a-z]*\\n(.*?)```", "$1"),
        ("!\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
        ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
        ("`([^`]*)`", "$1"),
        ("(?m)^#{1,6}[ ]+", ""),
        ("(?m)^>[ ]?", ""),
        ("(?m)^[ ]*[-*+•][ ]+", ""),
        ("\\*\\*([^*]+)\\*\\*", "$1"),
        ("__([^_]+)__", "$1"),
        ("\\n{3,}", "\n\n"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def language_of(c: Column | str) -> Column:
    """zh if at least 12 Han letters that are at least 8 % of the Latin ones, else en."""
    han, latin = F.regexp_count(col(c), F.lit(HAN)), F.regexp_count(col(c), F.lit("[A-Za-z]"))
    return F.when((han >= 12) & (han >= latin * 0.08), "zh").otherwise("en")


def source_title(path: Column | str) -> Column:
    """File stem without leading numbering and trailing version."""
    stem = F.regexp_extract(col(path), "([^/]+?)(?:\\.[A-Za-z0-9]+)?$", 1)
    x = F.regexp_replace(stem, "^[0-9]+[._ -]+", "")
    x = F.regexp_replace(x, "[ _-]*(?:[vV][0-9]+(?:\\.[0-9]+)*|[0-9]{8})$", "")
    return F.trim(F.replace(x, F.lit("_"), F.lit(" ")))


def mask_domain_account(c: Column | str) -> Column:
    """``DOMAIN\\x12345``: the four to six digits become asterisks."""
    return F.regexp_replace(col(c), DOMAIN_ACCOUNT, "$1*****$2")


def mask_email_id(c: Column | str) -> Column:
    """``d23456@host``: the digits of an account that is letters and four to six digits become asterisks."""
    return F.regexp_replace(col(c), EMAIL_ID, "$1$2*****@")


# HTML -------------------------------------------------------------------------------------------------------------


def html_title(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(c), "(?i)<title[^>]*>([^<]+)</title>", 1))


def html_main(c: Column | str) -> Column:
    """The inside of the first main or article element (attributes allowed), else the whole."""
    x = drop_boilerplate(c)
    main = F.regexp_extract(x, "(?is)<main(?:\\s[^>]*)?>(.*?)</main>", 1)
    article = F.regexp_extract(x, "(?is)<article(?:\\s[^>]*)?>(.*?)</article>", 1)
    return F.when(main != "", main).when(article != "", article).otherwise(x)


def drop_boilerplate(c: Column | str) -> Column:
    x = col(c)
    for tag in ("script", "style", "noscript", "header", "footer", "nav", "aside", "menu"):
        x = F.regexp_replace(x, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}>", " ")
    return x


def html_to_markdown(c: Column | str) -> Column:
    x = html_main(c)
    for level in range(1, 7):
        x = F.regexp_replace(x, f"(?is)<h{level}(?:\\s[^>]*)?>(.*?)</h{level}>", f"\n\n{'#' * level} $1\n\n")
    for pattern, to in (
        ("(?is)<pre(?:\\s[^>]*)?>(.*?)</pre>", "\n```\n$1\n```\n"),
        ("(?is)<code(?:\\s[^>]*)?>(.*?)</code>", "`$1`"),
        ("(?is)<(?:b|strong)(?:\\s[^>]*)?>(.*?)</(?:b|strong)>", "**$1**"),
        ("(?is)<(?:i|em)(?:\\s[^>]*)?>(.*?)</(?:i|em)>", "*$1*"),
        ("(?is)<a\\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)"),
        ("(?is)<li(?:\\s[^>]*)?>(.*?)</li>", "\n- $1"),
        ("(?is)<br\\s*/?>", "\n"),
        ("(?is)<p(?:\\s[^>]*)?>(.*?)</p>", "\n\n$1\n\n"),
        ("<[^>]*>", ""),
    ):
        x = F.regexp_replace(x, pattern, to)
    x = F.regexp_replace(decode_entities(x), "\\n[ \\t]*\\n(?:[ \\t]*\\n)+", "\n\n")
    return F.regexp_replace(x, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")


# small forms ------------------------------------------------------------------------------------------------------


_URL_GAP = re.compile(r"(https?://[A-Za-z0-9._/-]*[/._-])[ \n]+([a-z0-9][A-Za-z0-9._/-]*)")


@F.arrow_udf(T.StringType())
def _rejoined(texts: pa.Array) -> pa.Array:
    def whole(x: str) -> str:
        while True:
            made, n = _URL_GAP.subn(r"\1\2", x)
            if not n:
                return x
            x = made

    return pa.array([x if x is None or "http" not in x else whole(x) for x in texts.to_pylist()], pa.string())


def rejoin_urls(c: Column | str) -> Column:
    """Links broken by a space or line end before their tail are glued, until none is left."""
    return _rejoined(col(c))


def clean_symbols(c: Column | str) -> Column:
    """Box symbols written as formulas."""
    x = col(c)
    # Formulas and their characters.
    for formula, char in (("$\\square$", "☐"), ("$\\boxtimes$", "☒"), ("$\\checkmark$", "✓"), ("$\\bigcirc$", "○"), ("$\\rightarrow$", "→")):
        x = F.replace(x, F.lit(formula), F.lit(char))
    return x


def strip_asset_tokens(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "\\[\\[asset:[^\\]]*\\]\\]", "")


def truncate_text(c: Column | str, limit: int, marker: str = "…") -> Column:
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, limit), F.lit(marker))).otherwise(col(c))


def version_text(c: Column | str) -> Column:
    """The first version or revision stamp, empty without one."""
    return F.regexp_extract(col(c), "((?:[vV]|Ver\\.? ?|Rev\\.? ?)[0-9]+(?:\\.[0-9]+)+)", 1)


def is_watermark(c: Column | str) -> Column:
    """A line that is a short number, a date stamp or a document code."""
    x = F.trim(col(c))
    return x.rlike("^[0-9]{1,4}$") | x.rlike("^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$") | x.rlike("^[A-Z]{2,4}-[0-9]{3,6}$")


def looks_like_prose(c: Column | str) -> Column:
    """Sentence punctuation inside or at the end, or a list marker."""
    return col(c).rlike("[。！？；]|[.!?;](?: |$)") | col(c).rlike("^[ ]*(?:[-*•]|[0-9]{1,3}[.)]) ")


def is_generic_title(c: Column | str) -> Column:
    return F.lower(F.trim(col(c))).rlike("^(?:table|figure|page|form|untitled|表|圖|附件)?[ .:#_-]*[0-9]*$")


def is_noise_fact(c: Column | str) -> Column:
    """Whole numbers of one or two digits and fallback column names."""
    return col(c).rlike("^[0-9]{1,2}$") | F.lower(col(c)).rlike("^(?:column|col|欄)[ _]?[0-9]+$")


def canonical_hash(json: Column | str, schema: str) -> Column:
    """Hash of a JSON text that doesn't depend on the order of keys or on white space."""
    return F.sha2(F.to_json(F.from_json(col(json), schema)), 256)


def page_range(pages: Column | str) -> Column:
    """``a``, ``a-b`` for pages without a gap, else a list."""
    p = F.array_sort(F.array_distinct(col(pages)))
    n, low, high = F.size(p), F.array_min(p), F.array_max(p)
    return F.when(n <= 0, "").when(n == 1, low.cast("string")).when(high - low + 1 == n, F.concat(low.cast("string"), F.lit("-"), high.cast("string"))).otherwise(F.array_join(F.transform(p, lambda x: x.cast("string")), ","))
