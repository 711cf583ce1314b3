"""License scan by ordered signature rules.

Texts are reduced to lower-case words. Signature rules are regular expressions over the words: the
hand-written ones of license_signatures.py, and for names that are only mentioned, families (names,
versions) and forms (tag, grant, title, mention). Each has a priority and two keywords, words of every
string that it matches. Both must be among the text's words before the expression is tried. Of the matches, those
that lie inside a match of higher priority (then longer, then earlier) are suppressed. The fixed base
phrases are found by position beside the rules and are never suppressed.

Null texts count as empty. Ids are passed on as they are, null or repeated. Empty tables stay empty; other
columns are not read, whatever their names. A text's time grows as its length: places are looked up by
bisection, and suppression is one sweep over the sorted matches.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_signatures
from .common import released, small_slices, text_of

#: Fixed phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families: label, names as words (alternatives by |), versions.
FAMILIES = (
    ("mit", "mit|expat|mit x11", ""),
    ("apache", "apache|apache software|asl", "1 0|1 1|2|2 0"),
    ("gpl", "gpl|gnu gpl|gnu general public", "1|2|3|1 0|2 0|3 0"),
    ("gpl", "gnu general public|general public", "1|2|3|1 0|2 0|3 0"),
    ("lgpl", "lgpl|gnu lgpl", "2|3|2 0|2 1|3 0"),
    ("lgpl", "gnu lesser general public|gnu library general public|lesser general public", "2|3|2 0|2 1|3 0"),
    ("agpl", "agpl|gnu agpl", "1|3|1 0|3 0"),
    ("agpl", "gnu affero general public|affero general public", "1|3|1 0|3 0"),
    ("gfdl", "gfdl|gnu free documentation|gnu fdl", "1 1|1 2|1 3"),
    ("bsd", "bsd|berkeley software distribution", ""),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd", ""),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd", ""),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd", ""),
    ("isc", "isc", ""),
    ("mpl", "mpl|mozilla public", "1 0|1 1|2 0"),
    ("mpl", "mpl", "1 0|1 1|2 0"),
    ("epl", "eclipse public", "1 0|2 0"),
    ("epl", "epl", "1 0|2 0"),
    ("cddl", "cddl|common development and distribution", "1 0|1 1"),
    ("cpl", "common public", "1 0"),
    ("eupl", "eupl|european union public", "1 0|1 1|1 2"),
    ("artistic", "artistic|perl artistic", "1 0|2 0"),
    ("zlib", "zlib|zlib libpng", ""),
    ("boost", "boost|boost software|bsl", "1 0"),
    ("unlicense", "unlicense|the unlicense", ""),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "1|2"),
    ("python", "python|python software foundation|psf", "2|2 0"),
    ("php", "php", "3 0|3 01"),
    ("ruby", "ruby", ""),
    ("openssl", "openssl", ""),
    ("postgresql", "postgresql", ""),
    ("ofl", "ofl|sil open font|open font", "1 0|1 1"),
    ("odbl", "odbl|open database|odc open database", "1 0"),
    ("odc-by", "odc by|open data commons attribution", "1 0"),
    ("pddl", "pddl|open data commons public domain dedication", "1 0"),
    ("ms-pl", "ms pl|microsoft public", ""),
    ("ms-rl", "ms rl|microsoft reciprocal", ""),
    ("afl", "afl|academic free", "1 1|1 2|2 0|2 1|3 0"),
    ("osl", "osl|open software", "1 0|2 0|2 1|3 0"),
    ("ncsa", "ncsa|university of illinois ncsa open source", ""),
    ("sspl", "sspl|server side public", "1"),
    ("busl", "busl|business source", "1 0|1 1"),
    ("elastic", "elastic", "1|2|2 0"),
    ("cecill", "cecill|cecill b|cecill c", "1 0|1 1|2 0|2 1"),
    ("upl", "upl|universal permissive", "1 0"),
    ("cc0", "cc0|creative commons zero|cc zero", "1 0"),
    ("cc-by", "cc by", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "cc by sa", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "cc by nc", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "cc by nd", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-nd", "cc by nc nd", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by", "creative commons attribution", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "creative commons attribution sharealike|creative commons attribution share alike", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial|creative commons attribution non commercial", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "creative commons attribution noderivs|creative commons attribution no derivatives|creative commons attribution noderivatives", "1 0|2 0|2 5|3 0|4 0"),
)

#: Forms: name, priority, the expression around a name N and version V, a word that the form needs.
#: The licence word may be spelt with s or c; both spellings are one keyword.
FORMS = (
    ("tag", 100, r"spdx license identifier N(?: V)?(?: only| or later)?", "spdx"),
    ("title", 90, r"N license version V", "license"),
    ("version", 85, r"N(?: license)? version V", "version"),
    ("version", 85, r"N(?: license)? v V", "v"),
    ("grant", 80, r"(?:licensed|released|distributed|published|available|provided|redistributed|shared) (?:\w+ ){0,3}?under (?:the |a |an )?(?:terms of (?:the )?)?N(?: V)?(?: license)?", "under"),
    ("use", 70, r"(?:subject to|governed by|covered by|in accordance with) (?:the )?(?:terms of (?:the )?)?N(?: V)? license", "license"),
    ("mention", 50, r"(?:the )?N(?: V)? license", "license"),
)

FOUND = "array<struct<label:string,rule:string,priority:int,first:bigint,last:bigint>>"
#: Everything but digits, ASCII letters and bytes of other characters is a space; A-Z are lowered.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def keywords(expression: str) -> tuple[str, str]:
    """The two longest words that stand in all that a signature matches: words outside groups, not optional ones.

    A spelling in brackets counts as its first one ("licen[cs]e" as "licence"): scan() takes one for the other.
    """
    bare = re.sub(r"\S+ \?\S*", " ( ", expression)  # "share ?alike" may be one word
    while (fewer := re.sub(r"\([^()]*\)(?:[?*+]|\{[0-9,]*\})?", " ( ", bare)) != bare:
        bare = fewer
    told = ["license" if w == "licen[cs]e" else w for w in bare.split()]
    sure = [w for w in told if re.fullmatch("[a-z0-9]+", w)]
    best = sorted(dict.fromkeys(sure), key=lambda w: (-len(w), w))
    return best[0], best[min(1, len(best) - 1)]


def signatures() -> list[tuple[str, str, int, re.Pattern, bytes, bytes]]:
    """(label, form, priority, expression, keyword, keyword) of all rules, in order of priority."""
    out = []
    named = dict.fromkeys((label, name, versions) for label, names, versions in FAMILIES for name in names.split("|"))
    for label, name, versions in named:
        keyword = max(name.split(), key=len)
        for form, priority, around, needs in FORMS:
            if "V" in around and not versions:
                if form in ("title", "version"):
                    continue
            for v in versions.split("|") if form in ("title", "version") else [versions]:
                version = f"(?:{'|'.join(sorted(v.split('|'), key=len, reverse=True))})" if v else "(?!)"
                text = around.replace("N", name).replace("V", version).replace("license", "licen[sc]e")
                told = f"{label}-{v.replace(' ', '.')}" if form in ("title", "version") else label
                out.append((told, form, priority, re.compile(rf"(?a)(?<![^ ]){text}(?![^ ])".encode()), keyword.encode(), needs.encode()))
    for label, priority, text in license_signatures.lines():
        a, b = keywords(text)
        out.append((label, "signature", priority, re.compile(rf"(?a)(?<![^ ]){text}(?![^ ])".encode()), a.encode(), b.encode()))
    return sorted(out, key=lambda r: -r[2])


def suppressed(found: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, int, str, str]]:
    """(start, end, priority, label, form), without those inside one of higher priority, or as high and longer or earlier.

    What lies inside a suppressed match lies inside that match's suppressor too, so all matches are held against,
    level by level: the higher ones sorted by start, with the furthest end so far.
    """
    kept, starts, ends = [], [], []
    for priority in sorted({m[2] for m in found}, reverse=True):
        level = sorted((m for m in found if m[2] == priority), key=lambda m: (m[0], -m[1], m[3], m[4]))
        furthest = -1
        for m in level:
            above = bisect.bisect_right(starts, m[0])
            if m[1] > furthest and not (above and ends[above - 1] >= m[1]):
                kept.append(m)
            furthest = max(furthest, m[1])
        both = sorted([*zip(starts, ends), *((m[0], m[1]) for m in level)])
        starts, ends = [x for x, _ in both], list(accumulate((y for _, y in both), max))
    return sorted(kept)


def by_keyword(rules: list) -> dict[bytes, list]:
    out: dict = {}
    for r in rules:
        out.setdefault(r[4], []).append(r)
    return out


def scan(words: list[bytes], rules: dict[bytes, list]) -> list[dict]:
    """All finds of one text: base phrases by position, then the rules' matches that are not suppressed."""
    have = set(words)
    if b"licence" in have:
        have.add(b"license")
    joined, out, found = b"", [], []
    for phrase, label in BASE:
        if all(w in have for w in phrase.encode().split()):
            joined = joined or b" ".join(words)
            padded, want, at = b" " + joined + b" ", f" {phrase} ".encode(), -1
            while (at := padded.find(want, at + 1)) >= 0:
                found.append((at, at + len(want) - 2, 100, label, "base"))
    base, found = found, []
    for keyword in have & rules.keys():
        for label, form, priority, pattern, _, needs in rules[keyword]:
            if needs in have:
                joined = joined or b" ".join(words)
                found += [(m.start(), m.end(), priority, label, form) for m in pattern.finditer(joined)]
    if not base and not found:
        return out
    blanks = [i for i, c in enumerate(joined) if c == 32]
    for start, end, priority, label, form in [*base, *suppressed(found)]:
        out.append({"label": label, "rule": form, "priority": priority, "first": bisect.bisect_left(blanks, start), "last": bisect.bisect_left(blanks, end)})
    return out


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, found) for each document; first and last are numbers of words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = by_keyword(signatures())
        kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
        for b in batches:
            for part in small_slices(b, 1):
                counts, found = [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    words = words_of(t)
                    counts.append(len(words))
                    found.append(scan(words, rules))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], [id_col, "n_words", "found"])

    rows = docs.select(F.col(id_col), text_of(text_col).alias("t"))
    return rows.mapInArrow(released(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, found {FOUND}")
