"""Text keys and title clean-up, all on the JVM side.

Unicode normalisation and case folding come from the ICU library that Spark itself ships for
collations, called through ``java_method``.  Spark regards such a call as non-deterministic,
so the operators put it in a projection of its own, on de-duplicated values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from earshot.functions import constants as k


#: Spark finds these in a text one by one, which takes a small part of the time of a search for a class of characters.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ASCII_MARKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def _is_ascii(c: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(c) == F.length(c)


def nfkc(c: Column) -> Column:
    """The compatibility composition; ASCII is its own, and only other text is handed to the library."""
    c = F.coalesce(c, F.lit(""))
    return F.when(_is_ascii(c), c).otherwise(
        F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    )


def casefold(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(_is_ascii(c), F.lower(c)).otherwise(
        F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    )


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(k.UNKNOWN))


def squeeze(c: Column) -> Column:
    """Trim, and turn every run of white space into one space."""
    return F.trim(F.regexp_replace(c, k.BLANK + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{k.BLANK}+|{k.BLANK}+\z", "")


def credit_key(c: Column) -> Column:
    """The identity of an artist name: compatibility-normalised, squeezed, lower case."""
    return F.lower(squeeze(nfkc(c)))


def match_key(c: Column) -> Column:
    """Letters and digits only, lower case: the key of library matching."""
    text = F.coalesce(c, F.lit(""))
    other = F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}]", "")
    return F.when(_is_ascii(text), F.translate(F.lower(text), _ASCII_MARKS, "")).otherwise(other)


def catalog_key(c: Column) -> Column:
    """Like ``match_key`` for the catalog, which folds case fully and keeps the underscore."""
    return F.regexp_replace(casefold(nfkc(c)), r"[^\p{L}\p{N}_]", "")


def base64url(c: Column) -> Column:
    """Unpadded URL-safe base64 of the UTF-8 text, without the line breaks ``base64`` adds."""
    return F.rtrim(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def from_base64url(c: Column) -> Column:
    """Text behind ``base64url``; a length no encoding has, gives NULL."""
    text = F.translate(c, "-_", "+/")
    body = F.when(F.translate(text, _ALPHABET, "") == "", text).otherwise(F.regexp_replace(text, r"[^A-Za-z0-9+/]", ""))
    return F.make_valid_utf8(F.try_to_binary(body, F.lit("base64")).cast("string"))


def artist_id(key: Column) -> Column:
    """The id of an artist, from the name's ``credit_key``."""
    return F.concat(F.lit("artist-"), base64url(key))


def artist_name_from_id(c: Column) -> Column:
    return F.when(c.startswith("artist-"), from_base64url(F.substring(c, 8, 1 << 30)))


def clean_listen_title(c: Column) -> Column:
    """Without bracketed parts and without everything from the first ``feat.`` on."""
    c = F.regexp_replace(c, k.LISTEN_TITLE_ROUND, "")
    c = F.regexp_replace(c, k.LISTEN_TITLE_SQUARE, "")
    c = F.regexp_replace(c, k.LISTEN_TITLE_FEAT, "$1")
    return strip(c)


def clean_recording_title(c: Column, catalog: bool = False) -> Column:
    """Without video/lyrics markers and guest tails; other brackets, as in "(Live)", stay."""
    c = F.coalesce(c, F.lit(""))
    # Neither pattern is looked for in a text without what it cannot do without.
    shorn = F.regexp_replace(c, k.CATALOG_MARKERS if catalog else k.LIBRARY_MARKERS, "")
    shorn = F.when(c.contains("(") | c.contains("["), shorn).otherwise(c)
    tail = k.CATALOG_FEAT_TAIL if catalog else k.LIBRARY_FEAT_TAIL
    return F.when(F.lower(c).contains("f"), F.regexp_replace(shorn, tail, "")).otherwise(shorn)


def title_prefix(c: Column) -> Column:
    """What stands before the first " - ", or NULL."""
    return F.when(F.instr(c, " - ") > 0, F.substring_index(c, " - ", 1))


def title_rest(c: Column) -> Column:
    """What stands after the first " - ", or NULL."""
    at = F.instr(c, " - ")
    return F.when(at > 0, F.substring(c, at + 3, F.lit(1 << 30)))


def cover_key(track_name: Column, album_name: Column, artist_name: Column, track_id: Column, album_id: Column) -> Column:
    """The album id, else the track id, else the encoded description of what is missing."""
    named = F.struct(
        F.when(blank(track_name), F.lit("album")).otherwise(F.lit("song")).alias("kind"),
        F.coalesce(F.nullif(track_name, F.lit("")), album_name).alias("name"),
        artist_name.alias("artist"),
    )
    encoded = F.concat(F.lit("cover-"), base64url(F.to_json(named, {"ignoreNullFields": "false"})))
    return F.coalesce(F.nullif(album_id, F.lit("")), F.nullif(track_id, F.lit("")), encoded)


def contains_text(c: Column, query: str) -> Column:
    """Substring search, any case; ``%`` and ``_`` in the query stay wildcards."""
    return c.ilike("%" + query.replace("\\", "\\\\") + "%")


def allowed_image(url: Column) -> Column:
    """An https address on an allowed host or one of its subdomains."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    on_host = F.lit(False)
    for name in k.IMAGE_HOSTS:
        on_host = on_host | (host == name) | host.endswith("." + name)
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & on_host, F.lit(False))


def valid_catalog_id(c: Column) -> Column:
    return F.coalesce(c.rlike(k.CATALOG_ID), F.lit(False))
