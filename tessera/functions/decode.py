"""Evidence-based decoding of file bytes to text, as column expressions.

A UTF-16 mark decides; else valid UTF-8; else Windows-1252, unless a byte that no such text holds speaks against it.
Nothing is guessed: what cannot be decoded is an error with the byte and where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes 80-9F that Windows-1252 defines, and their characters, in byte order (fixed by the code page).
CP1252_BYTES = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_CHARS = CP1252_BYTES.decode("cp1252")
#: Controls other than TAB, LF, FF, CR; DEL; the five bytes the code page leaves open.
REJECTED = "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F\\x81\\x8D\\x8F\\x90\\x9D]"


def decoded(content: Column) -> Column:
    """struct(text, encoding, error) of a binary column; exactly one of text and error is set."""
    mark = F.substring(content, 1, 2)
    little, big = mark == F.lit(bytes((0xFF, 0xFE))), mark == F.lit(bytes((0xFE, 0xFF)))
    utf8_mark = F.substring(content, 1, 3) == F.lit(bytes((0xEF, 0xBB, 0xBF)))
    latin = F.decode(content, "ISO-8859-1")
    valid = F.is_valid_utf8(content.cast("string"))
    at = F.regexp_instr(latin, F.lit(REJECTED))
    odd = F.octet_length(content) % 2 == 1
    hex_at = F.lpad(F.hex(F.ascii(F.substring(latin, at, F.lit(1)))), 2, "0")
    kind = (
        F.when(little, "utf-16le").when(big, "utf-16be").when(valid, "utf-8").when(utf8_mark, F.lit(None)).when(at == 0, "windows-1252")
    )
    error = (
        F.when((little | big) & odd, "UTF-16 text of odd length")
        .when(little | big | valid, F.lit(None))
        .when(utf8_mark, "UTF-8 mark, but invalid UTF-8")
        .when(at > 0, F.concat(F.lit("undecodable byte 0x"), hex_at, F.lit(" at offset "), (at - 1).cast("string")))
    )
    # a UTF-16 text of odd length is never decoded
    whole = F.when(odd, F.lit(None)).otherwise(content)
    text = (
        F.when(little, F.decode(whole, "UTF-16LE"))
        .when(big, F.decode(whole, "UTF-16BE"))
        .when(valid, content.cast("string"))
        .when(~utf8_mark & (at == 0), F.translate(latin, "".join(map(chr, CP1252_BYTES)), CP1252_CHARS))
    )
    text = F.when(error.isNull(), F.regexp_replace(text, "^﻿", ""))
    return F.struct(text.alias("text"), F.when(error.isNull(), kind).alias("encoding"), error.alias("error"))
