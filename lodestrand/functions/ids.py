"""Identities as columns: typed prefixes over SHA-256 digests of length-framed fields, and canonical names."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fingerprint, normalize_path


@lru_cache(1)
def _compositions() -> str:
    """Canonical compositions of one code point and of two, from the Unicode database, as a JSON object."""
    pairs = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if "\ud800" <= c <= "\udfff":
            continue
        composed, apart = unicodedata.normalize("NFC", c), unicodedata.decomposition(c)
        if composed != c:
            pairs[c] = composed
        elif apart and "<" not in apart and len(apart.split()) == 2:
            pairs["".join(chr(int(x, 16)) for x in apart.split())] = c
    return json.dumps(pairs, ensure_ascii=True)


def nfc(name: Column) -> Column:
    """Unicode's composed form, letter by letter: a mark joins the letter before it, as Hangul syllables join.

    Names without code points from U+0300 on are their own form and go by unread. Marks that stand in another than
    the canonical order aren't reordered.
    """
    table = F.from_json(F.lit(_compositions()), "map<string,string>")
    syllables = F.array(*[F.lit(x) for x in (0x1100, 0x1161, 0x11A7, 0xAC00)])

    def step(acc: Column, c: Column) -> Column:
        last, point = F.right(acc, F.lit(1)), F.ascii(c)
        joined = F.coalesce(F.try_element_at(table, F.concat(last, c)), _hangul(last, point, syllables))
        return F.when(joined.isNotNull(), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), joined)).otherwise(F.concat(acc, F.coalesce(F.try_element_at(table, c), c)))

    composed = F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(""), step)
    return F.when(name.rlike("[^\\x{0}-\\x{2FF}]"), composed).otherwise(name)


def _hangul(last: Column, point: Column, base: Column) -> Column:
    """The syllable of a leading and a medial consonant, or of a syllable without a final and one; null otherwise."""
    of = F.ascii(last)
    lead, medial, final = of - base[0], point - base[1], point - base[2]
    pair = F.when((lead >= 0) & (lead < 19) & (medial >= 0) & (medial < 21), base[3] + (lead * 21 + medial) * 28)
    open_ = (of >= base[3]) & (of < base[3] + 11172) & ((of - base[3]) % 28 == 0)
    point = F.coalesce(pair, F.when(open_ & (final > 0) & (final < 28), of + final))
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def logical_path(path: Column) -> Column:
    """A path's canonical form; null where it has none."""
    return nfc(normalize_path(path))


def file_id(path: Column) -> Column:
    """Of the canonical path; null where it has none."""
    p = logical_path(path)
    return F.when(p.isNotNull(), fingerprint("file1_", F.array(F.lit("file-id"), p)))


def entity_id(namespace: Column, scope: Column, owner: Column, name: Column) -> Column:
    """Of a named declaration; ``scope`` is unit, file or owner, and ``owner`` the id that the latter two name. Null for an empty name."""
    return F.when(F.length(name) > 0, fingerprint("decl1_", F.array(F.lit("entity-id"), namespace, scope, F.coalesce(owner, F.lit("")), nfc(name))))


def anonymous_id(scope: Column, owner: Column, tokens: Column, ordinal: Column) -> Column:
    return fingerprint("decl1_", F.array(F.lit("entity-id"), F.lit("anonymous"), scope, F.coalesce(owner, F.lit("")), tokens, ordinal.cast("string")))


def macro_id(file: Column, name: Column) -> Column:
    return F.when(F.length(name) > 0, fingerprint("macro1_", F.array(F.lit("macro-id"), file, nfc(name))))


def occurrence_id(of: Column, file: Column, tokens: Column, ordinal: Column) -> Column:
    """Of a declaration's or a macro's occurrence: what it is of, its file, its canonical tokens, and its number among equal ones."""
    return fingerprint("occ1_", F.array(F.lit("occurrence-id"), of, file, tokens, ordinal.cast("string")))


def child_id(parent: Column, role: Column, name: Column, tokens: Column, ordinal: Column) -> Column:
    """A parameter's id comes from its ordinal alone; a field's or variant's from its name, or from its tokens and ordinal where it has none."""
    key = F.when(role == "parameter", F.lit("semantic-ordinal")).when(F.length(name) > 0, nfc(name)).otherwise(F.coalesce(tokens, F.lit("")))
    number = F.when((role == "parameter") | F.coalesce(F.length(name) == 0, F.lit(True)), ordinal).otherwise(F.lit(0))
    return fingerprint("child1_", F.array(F.lit("child-id"), parent, role, key, number.cast("string")))
