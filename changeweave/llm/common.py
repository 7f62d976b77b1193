"""Small helpers shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeweave.functions.scratch import forget, shared_folder, written

__all__ = ["BLANKS", "TOKENS", "WORD_PATTERN", "crc_bucket", "crc_bucket_py", "forget", "letter_runs", "quoted", "shared_folder", "split_alnum", "split_words", "table", "written"]

#: The blank characters of the contracts: space and \x09-\x0D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Java and RE2 pattern of one whitespace-delimited word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def crc_bucket_py(doc_id: int, n: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % n


def split_words(text: bytes) -> list[bytes]:
    """The words between blanks; bytes.split() takes the same six characters as blanks."""
    return text.split()


_ALNUM = bytes(b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in range(256))


def split_alnum(text: bytes) -> list[bytes]:
    """Words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8 bytes."""
    return text.lower().translate(_ALNUM).split()




def _numerals(start: int, stop: int) -> str:
    """Word characters that are no letters and no decimal digits (fractions, superscripts, circled digits), for a character class."""
    return "".join(re.escape(c) for c in map(chr, range(start, stop)) if unicodedata.category(c) in ("No", "Nl"))


#: Numerals of the first plane, and everything from the second, where the exact class would be slow; from the third on there are ideographs.
_MAYBE_NUMERAL = re.compile(f"[{_numerals(0, 0x10000)}\U00010000-\U0001FFFF]")
_WORD_LETTERS, _SURE_LETTERS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_numerals(0, 0x20000)}]+")


def letter_runs(text: str) -> list[str]:
    """Runs of Unicode letters. The exact class is asked only where a text may have numerals of the rare kinds."""
    return (_SURE_LETTERS if _MAYBE_NUMERAL.search(text) else _WORD_LETTERS).findall(text)


TOKENS = re.compile(r"[^\W_]+")
