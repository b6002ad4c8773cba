"""Reading the words of a page: repair of garbled text, and plain words."""

from __future__ import annotations

import html
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# U+FFFD; UTF-8 read as a Western or as a Cyrillic single-byte charset; a run of accented letters;
# Cyrillic small letters before capitals; half-width kana and box drawing, as wrong charsets give them
_GARBLED = re.compile(
    r"(?=[^\x00-\x7f])(?:"  # a quick no at every ASCII character
    "�|[ÂÃÅÐÑâã][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]"
    "|[ВГРСЃ][\u0080-¿–—‘-„†-•…‰‹›€№ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐґЁЄЇІіёєјЅѕї]"
    "|[À-ÖØ-öø-ÿ]{4,}|[а-яё][А-ЯЁ]{2,}|[｡-ﾟ]{3,}|[─-▟])"
)
#: The same test as a Java pattern, so that only garbled rows send their bytes to Python.
GARBLED_JAVA = _GARBLED.pattern

_META = re.compile(rb"<meta[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")

# Charsets tried after UTF-8, in this order.
_CHARSETS = ["koi8-r", "cp1251", "iso8859-5", "cp866", "shift_jis", "euc_jp", "iso2022_jp", "gb18030", "cp1252", "latin-1"]
# The most frequent letters of Russian, and Japanese particles and punctuation.
_COMMON = set("оеаинтсрвлоу")
_MIXED = re.compile("[a-z][а-яё]|[а-яё][a-z]")


def _plausible(s: str) -> float:
    """How much a decoded text looks like prose in one of the scripts at hand."""
    outside = [c for c in s if ord(c) > 127]
    if not outside:
        return 1.0
    good = 0.0
    for c in outside:
        name = ord(c)
        if c in _COMMON:
            good += 1.0
        elif 0x430 <= name <= 0x44F:
            good += 0.7
        elif 0x3040 <= name <= 0x30FF or c in "。、":
            good += 1.0
        elif 0x4E00 <= name <= 0x9FFF:
            good += 0.6
        elif c in "äöüßéèàáíóúñçêôîïâûùœ¿¡«»·©–—’“”„ÄÖÜÀÉ":
            good += 0.8
        elif 0x410 <= name <= 0x42F:
            good += 0.1
        elif c in "\xad\xa0•":
            good += 0.5
        elif not c.isprintable() or unicodedata.category(c) in ("Cc", "Co", "Cn"):
            good -= 2.0
    # letters of two scripts inside one word betray a wrong charset
    return (good - 3.0 * len(_MIXED.findall(s))) / len(outside)


def decode_page(raw: bytes) -> str:
    """The text of a page's bytes, whatever its headers say: UTF-8 if valid, else the most plausible charset."""
    names = ["utf-8"]
    m = _META.search(raw[:4096])
    if m:
        names.append(m.group(1).decode("ascii"))
    best, score = None, -9.0
    for name in [*names, *_CHARSETS]:
        try:
            s = raw.decode(name)
        except (UnicodeDecodeError, LookupError, UnicodeError):
            continue
        if name == "utf-8":
            best = s
            break
        p = _plausible(_TAG.sub("", s))
        if p > score + 1e-9:
            best, score = s, p
    if best is None:
        best = raw.decode("utf-8", "replace")
    return html.unescape(_TAG.sub("\n", _DROP.sub("\n", best)))


def unscramble(text: str) -> str:
    """Undo UTF-8 read as a single-byte charset, where that is what happened."""
    for charset in ("cp1252", "latin-1"):
        out = bytearray()
        try:
            for c in text:
                out += c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode(charset)
            return out.decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return text


def readable(text: str | None, raw: bytes | None, garbled: bool | None = None) -> str:
    """A page's text with garbling undone as far as its bytes or the text itself allow; null reads as empty.

    ``garbled`` is what `GARBLED_JAVA` said of the text, where it was asked already.
    """
    if not text:
        return ""
    if not (_GARBLED.search(text) if garbled is None else garbled):
        return text
    if raw:
        page = decode_page(raw)
        if page.strip():
            return page
    return unscramble(text)


_HYPHEN = re.compile(r"[-\u00ad\u2010]\s*\n")
_BREAK = re.compile(r"(?<=\w)[-\u00ad\u2010]\s*\n\s*(?=\w)")
_INVISIBLE = regex.compile(r"[\p{Mn}\p{Cf}]+")
_WORD = re.compile(r"\w+")
# Japanese and Chinese have no blanks: a change of script ends a word there (marks are folded away by `plain`)
_KANA_HAN = re.compile("[\u3040-\u30ff\u4e00-\u9fff]")
_SCRIPT_WORD = re.compile("[\u30a0-\u30ff]+|[\u4e00-\u9fff\u3005]+|[\u3040-\u309f]+|[^\\W\u3005\u3040-\u30ff\u4e00-\u9fff]+")


def plain(text: str) -> str:
    """Entities resolved, words broken over lines joined, compatibility forms, marks and case folded, invisible characters removed."""
    s = html.unescape(text) if "&" in text else text
    if _HYPHEN.search(s):
        s = _BREAK.sub("", s)
    if not s.isascii():
        s = _INVISIBLE.sub("", unicodedata.normalize("NFKD", s))
    return s.casefold()


def words(text: str) -> list[str]:
    """The plain words of a text, in order; in Japanese and Chinese, runs of one script."""
    s = plain(text)
    return (_SCRIPT_WORD if _KANA_HAN.search(s) else _WORD).findall(s)


def page_rows(docs: DataFrame, doc: str, text: str, raw: str | None) -> DataFrame:
    """Rows ``page, text, garbled, raw`` of the pages with an id and a text; the bytes go along where the text is garbled."""
    garbled = F.col(text).rlike(GARBLED_JAVA)
    body = F.when(garbled, F.col(raw)) if raw else F.lit(None).cast("binary")
    rows = docs.select(F.col(doc).cast("long").alias("page"), F.col(text).alias("text"), garbled.alias("garbled"), body.alias("raw"))
    return rows.filter(F.col("page").isNotNull() & (F.length("text") > 0))
