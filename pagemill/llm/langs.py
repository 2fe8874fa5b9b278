"""Language codes, label spellings and a light guess of the language of a text by script and function words."""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGS = ("en", "zh-TW", "de", "fr", "ja")

# Spellings of the labels, in lower case with "-" for "_".
SPELLINGS = {
    "en": ("en", "en-us", "en-gb", "eng", "english"),
    "zh-TW": ("zh", "zh-tw", "zh-hant", "zh-hant-tw", "chi", "zho", "chinese", "traditional-chinese"),
    "de": ("de", "de-de", "de-at", "de-ch", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fr-fr", "fr-be", "fr-ca", "fra", "fre", "french"),
    "ja": ("ja", "ja-jp", "jp", "jpn", "japanese"),
}

# Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with on by this be are from or an not have at which has a was were if when no more than can must",
    "de": "der die das und in zu den von mit ist des dem ein eine für auf im nicht sich als auch bei nach wird am aus werden sie oder einer um an",
    "fr": "le la les de des du et à en un une dans pour que est par sur au qui ne pas se plus ce avec sont aux ou cette il être",
    "zh-TW": "的 於 應 為 之 並 與 及 以 在 是 不 由 至 且 或 有 將",
    "ja": "は を に の が で と も た い す る",
}
WORDS = {lang: frozenset(text.split()) for lang, text in FUNCTION_WORDS.items()}
_KANA = re.compile("[぀-ヿ]")
_HAN = re.compile("[㐀-鿿豈-﫿⼀-⿕]")


def label(column: Column | str) -> Column:
    """The code of a label in any spelling; null where it is missing, undetermined or unknown."""
    column = F.col(column) if isinstance(column, str) else column
    codes = F.create_map(*(F.lit(x) for x in chain.from_iterable((s, c) for c, spelled in SPELLINGS.items() for s in spelled)))
    return codes[F.regexp_replace(F.lower(F.trim(column)), "_", "-")]


def by_script(text: str) -> str | None:
    """The language of a text in CJK letters; null for others."""
    if not text.isascii():
        kana = len(_KANA.findall(text))
        han = len(_HAN.findall(text)) if kana or _HAN.search(text) else 0
        if kana + han > 0.15 * len(text):
            return "ja" if kana * 12 > han else "zh-TW"
    return None


def by_words(words: Counter) -> str:
    """Among the languages of the Latin script, the one whose function words are the most frequent."""
    return max((sum(words[w] for w in WORDS[lang]), -k, lang) for k, lang in enumerate(("en", "de", "fr")))[2]


def guess(text: str) -> str:
    """The language of a text by its script; among those of the Latin script by function words."""
    return by_script(text) or by_words(Counter(text.lower().split()))
