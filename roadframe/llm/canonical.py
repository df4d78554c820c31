"""Visually identical text with different characters (problem 10).

A text is rewritten in one pass by a transducer over grapheme clusters. Its
mapping is compiled once: each character's image is the composition of the images
of its decomposed parts, so width, ligatures, look-alike letters and accents
combine without listing every combination. Which letters of other scripts look
like a Latin one is taken by rule from the Unicode confusables data that Spark's
own ICU library carries (``published_prototypes``), so no list of them is kept here.

The compiler refuses a conflicting table: a character and its image must look
alike by the published data (their prototypes are equal), so no two characters
that the data keep apart can share an image; every image is its own image; every
printable ASCII character stays itself; digits stay digits, and raised or lowered
ones stay apart from plain ones. Clusters are matched longest first: an emoji
joined by zero-width joiners is one cluster and keeps its joiners, since without
them it looks different; a flag of tag characters and a Mongolian letter keep
their selectors; elsewhere invisible characters vanish.

Texts are compared by a 128-bit hash of the canonical form. Defined cases: null
texts look like nothing and are no case; texts that become empty look alike;
equal strings are no case.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import warnings
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyspark
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframe.session import materialize

# Letters of the Latin script and Roman numerals with the same shape as a Latin letter or mark.
LATIN_FORMS = dict(zip("ⅠⅤⅩⅬⅭⅮⅯ" "ⅰⅴⅹⅼⅽⅾⅿ" "ɡǃ", "IVXLCDM" "ivxlcdm" "g!"))
#: Scripts whose letters may look like Latin ones; the last has no cases.
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
# Letters that the published data put with a Latin letter but that a reader tells apart.
ONLY_SIMILAR = "αγι\u1fbeρσυϱϒϺᴦ" "гѡҽꙇ" "ազցռսքգ" "ᏏᎵᎥᎩᏒᏛᏕᏤ" "ⲅ"
# Joined letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij",
             "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz"}
# Blanks of other kinds, and line ends of other kinds.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LINE_ENDS = "\r\x85\u2028\u2029"
# Characters that show nothing, as ranges (default-ignorable ones without the variation selectors).
_HIDDEN = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
           (0x2060, 0x206F), (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE007F))
INVISIBLE = "".join(chr(c) for a, b in _HIDDEN for c in range(a, b + 1))
# Emoji that start a published joined sequence, and those that follow a joiner in one.
_JOIN_START = "⛓❤\U0001f34b\U0001f344\U0001f3c3-\U0001f3c4\U0001f3ca-\U0001f3cc\U0001f3f3-\U0001f3f4\U0001f408\U0001f415\U0001f426\U0001f43b\U0001f441\U0001f466-\U0001f469\U0001f46e-\U0001f487\U0001f575\U0001f62e\U0001f635-\U0001f636\U0001f642\U0001f645-\U0001f64e\U0001f6a3\U0001f6b4-\U0001f6b6\U0001f926\U0001f935-\U0001f93e\U0001f9b8-\U0001f9b9\U0001f9cd-\U0001f9df\U0001faf1"
_PICTURE = ("↔↕➡♀♂⚕⚖⚧☠✈❄❤⬛\U0001f308\U0001f32b\U0001f33e\U0001f373\U0001f37c\U0001f384\U0001f393\U0001f3a4\U0001f3a8\U0001f3eb\U0001f3ed\U0001f466-\U0001f469\U0001f48b"
            "\U0001f4a5\U0001f4a8\U0001f4ab\U0001f4bb\U0001f4bc\U0001f525\U0001f527\U0001f52c\U0001f5e8\U0001f680\U0001f692\U0001f7e9\U0001f7eb\U0001f91d\U0001f9af-\U0001f9b3"
            "\U0001f9ba\U0001f9bc\U0001f9bd\U0001f9d1\U0001f9d2\U0001fa70\U0001fa79\U0001faf2")
_MODIFIER = "\ufe0f\U0001f3fb-\U0001f3ff"


def _width(char: str) -> str:
    """A full- or half-width form in its usual width."""
    kind = unicodedata.decomposition(char).split(" ", 1)
    return chr(int(kind[1], 16)) if kind[0] in ("<wide>", "<narrow>") else char


@lru_cache(maxsize=1)
def published_prototypes() -> dict[str, str]:
    """What each confusable character looks like, from the confusables file in Spark's ICU library.

    Read on the driver, which always has Spark's jars; without the library a
    warning says so and only the fixed values above are used.
    """
    homes = [h for h in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)) if h]
    jars = [j for h in homes for j in sorted(glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))]
    if not jars:
        warnings.warn("no ICU library beside Spark: look-alike letters are limited to the fixed values", stacklevel=2)
        return {}
    with zipfile.ZipFile(jars[0]) as jar:
        name = next(n for n in jar.namelist() if n.endswith("confusables.cfu"))
        raw = jar.read(name)
    big = raw[8] == 1
    order = ">" if big else "<"
    start = struct.unpack_from(order + "H", raw, 0)[0]  # the data follow the file's header
    _, _, _, keys_at, n_keys, index_at, n_index, text_at, n_text = struct.unpack_from(order + "I4sIIIIIII", raw, start)
    keys = struct.unpack_from(f"{order}{n_keys}I", raw, start + keys_at)
    index = struct.unpack_from(f"{order}{n_index}H", raw, start + index_at)
    text = raw[start + text_at: start + text_at + 2 * n_text]
    codec = "utf-16-be" if big else "utf-16-le"
    out = {}
    for key, value in zip(keys, index):
        size = (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else text[2 * value: 2 * (value + size)].decode(codec)
    return out


def skeleton(text: str) -> str:
    """The prototypes of a text's decomposed characters: equal for texts that the published data call confusable."""
    known = published_prototypes()
    return unicodedata.normalize("NFD", "".join(known.get(c, c) for c in unicodedata.normalize("NFD", text)))


@lru_cache(maxsize=1)
def lookalikes() -> dict[str, str]:
    """Letters of other scripts with the shape of a Latin letter of the same case, and the fixed values."""
    found = dict(LATIN_FORMS)
    latin: dict[tuple[str, bool], str] = {}
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        latin[skeleton(c), c.isupper()] = c
    for char, prototype in published_prototypes().items():
        script = unicodedata.name(char, "").split(" ")[0]
        if script not in SCRIPTS or char in ONLY_SIMILAR or unicodedata.category(char) not in ("Lu", "Ll", "Lo"):
            continue
        upper = char.isupper() or script == "LISU" or script == "CHEROKEE"
        letter = latin.get((prototype, upper))
        if letter is not None and letter.isascii():
            found[char] = letter
    return found


def compile_mapping(letters: dict[str, str] | None = None, ligatures: dict[str, str] | None = None) -> dict[str, str]:
    """Image of every single character that has another form; raises ``ValueError`` on a conflict."""
    letters = lookalikes() if letters is None else letters
    ligatures = LIGATURES if ligatures is None else ligatures
    for char in [*letters, *ligatures]:
        if char.isascii():
            raise ValueError(f"{char!r} must stay itself")
    drop = set(INVISIBLE)
    mapping: dict[str, str] = {}
    for code in range(0x80, 0x30000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or 0x3400 <= code < 0xA000:
            continue
        char = chr(code)
        image = "" if char in drop else " " if char in BLANKS else "\n" if char in LINE_ENDS else None
        if image is None:
            parts = unicodedata.normalize("NFD", ligatures.get(char, _width(char)))
            image = unicodedata.normalize("NFC", "".join(letters.get(p, ligatures.get(p, "" if p in drop else p)) for p in parts))
        if image != char:
            mapping[char] = image
    mapping.update((chr(c), "") for c in range(0xE0000, 0xE0080))
    _refuse_conflicts(mapping)
    return mapping


def _refuse_conflicts(mapping: dict[str, str]) -> None:
    shown = bool(published_prototypes())
    for char, image in mapping.items():
        again = unicodedata.normalize("NFC", "".join(mapping.get(c, c) for c in image))
        if again != image:
            raise ValueError(f"the image of {char!r} is not stable: {image!r} becomes {again!r}")
        if unicodedata.normalize("NFKC", char).isdigit() and not image.isdigit():
            raise ValueError(f"digit {char!r} would become {image!r}")
        if unicodedata.decomposition(char).startswith(("<super>", "<sub>")):
            raise ValueError(f"raised or lowered {char!r} would become {image!r}")
        if shown and image.strip() and skeleton(char) != skeleton(image) and unicodedata.normalize("NFKD", char) != unicodedata.normalize("NFKD", image):
            if skeleton(unicodedata.normalize("NFKD", char)) != skeleton(image):
                raise ValueError(f"{char!r} and {image!r} do not look alike")


class Transducer:
    """One pass over the clusters of a text that hold anything but plain ASCII."""

    def __init__(self, letters: dict[str, str], mapping: dict[str, str]) -> None:
        self.letters, self.mapping = letters, mapping
        hidden = "".join(f"{chr(a)}-{chr(b)}" for a, b in _HIDDEN)
        marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in _mark_ranges())
        joined = f"[{_JOIN_START}][{_MODIFIER}{hidden}]*(?:\u200d[{hidden}]*[{_PICTURE}][{_MODIFIER}{hidden}]*)+"
        kept = "\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f|[\u1820-\u18aa][\u180b-\u180d\u180f]"
        jamo = f"[ᄀ-ᅞ가-힣](?:[{hidden}]*[ᅡ-ᇿ])+"
        # longest first: joined emoji, flags and letters with their selectors, syllables of jamo, a base with marks or invisibles, a bare character
        self.cluster = re.compile(f"({joined})|({kept})|{jamo}|.?[{marks}{hidden}ﾞﾟ]+|.", re.DOTALL)
        # every ASCII character starts a cluster, so a run of others with the one before it holds whole clusters
        self.run = re.compile(f"\r(?:[{hidden}]*\n)?|[\x00-\x0c\x0e-\x7f]?[^\x00-\x7f]+")
        self.memo: dict[str, str] = {}

    def _image(self, match: re.Match) -> str:
        run = match.group()
        known = self.memo.get(run)
        if known is None:
            known = "\n" if run[0] == "\r" else self.cluster.sub(self._transduce, run)
            if len(run) <= 48:
                if len(self.memo) > 300_000:
                    self.memo.clear()
                self.memo[run] = known
        return known

    def _transduce(self, match: re.Match) -> str:
        cluster = match.group()
        if match.group(1) is not None:
            plain = "".join(c for c in cluster if c == "\u200d" or c not in INVISIBLE)
            return re.sub("\u200d+", "\u200d", plain).rstrip("\u200d")
        if match.group(2) is not None:
            return cluster
        if len(cluster) == 1:
            return self.mapping.get(cluster, cluster)
        parts = unicodedata.normalize("NFD", "".join(self.mapping.get(c, c) for c in cluster))
        return unicodedata.normalize("NFC", "".join(self.letters.get(p, p) for p in parts))

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        return self.run.sub(self._image, text)


def _mark_ranges() -> Iterator[tuple[int, int]]:
    """Ranges of combining marks below U+20000 and the variation selectors among them."""
    start = None
    for code in range(0x300, 0x20000):
        mark = unicodedata.category(chr(code)) in ("Mn", "Mc", "Me")
        if mark and start is None:
            start = code
        elif not mark and start is not None:
            yield start, code - 1
            start = None


_TRANSDUCER: list[Transducer] = []


def transducer(tables: tuple[dict[str, str], dict[str, str]] | None = None) -> Transducer:
    """The worker's transducer; executors pass the tables that the driver compiled."""
    if not _TRANSDUCER:
        letters, mapping = tables if tables is not None else (lookalikes(), compile_mapping())
        _TRANSDUCER.append(Transducer(letters, mapping))
    return _TRANSDUCER[0]


def _shared_tables(documents: DataFrame) -> Broadcast:
    """The compiled tables, some ten thousand entries whatever the corpus."""
    ours = transducer()
    return documents.sparkSession.sparkContext.broadcast((ours.letters, ours.mapping))


def canonical_text(text: str | None) -> str | None:
    return None if text is None else transducer()(text)


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def canonical_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, canonical)``; null stays null."""
    tables = _shared_tables(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = transducer(tables.value)
        for batch in batches:
            out = [None if (t := v.as_py()) is None else change(t) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "canonical"])

    return documents.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("_t")).mapInArrow(run, f"{key} bigint, canonical string")


def text_forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, form, exact)``: hashes of the canonical form and of the string, for rows with a text."""
    tables = _shared_tables(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = transducer(tables.value)
        for batch in batches:
            form, exact = [], []
            for value in batch.column(1):
                words = value.as_py()
                raw = _digest(words)
                canonical = change(words)
                exact.append(raw)
                form.append(raw if canonical is words or canonical == words else _digest(canonical))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.binary()), pa.array(exact, pa.binary())],
                                             names=[key, "form", "exact"])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(text).alias("_t"))
    return rows.mapInArrow(run, f"{key} bigint, form binary, exact binary")


def _mixed_members(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(form, doc_id, exact)`` of the documents whose form is written in two or more ways."""
    forms = materialize(text_forms(documents, key, text), "forms")
    mixed = forms.groupBy("form").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("form")
    return materialize(forms.join(mixed, "form"), "members")


def lookalike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_a, doc_b)``, doc_a < doc_b: different strings with one canonical form.

    Only forms written in two or more ways, found by one aggregation, enter the
    join; copies of one string never pair with each other. This lists every pair,
    as its definition asks; ``lookalike_classes`` gives the same links as one row
    per document.
    """
    members = _mixed_members(documents, key, text)
    right = members.select("form", F.col(key).alias("doc_b"), F.col("exact").alias("other"))
    return (members.join(right, "form").where((F.col("exact") != F.col("other")) & (F.col(key) < F.col("doc_b")))
            .select(F.col(key).alias("doc_a"), "doc_b").distinct())


def lookalike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, class_id, variant_id, n_links)`` of every document that has a look-alike.

    ``class_id`` is the smallest document of the form, ``variant_id`` the smallest
    with the same string; ``n_links`` counts the documents of the form with another
    string. Two documents are linked when their classes are equal and their variants
    differ, so copies are never expanded into pairs.
    """
    members = _mixed_members(documents, key, text)
    variants = materialize(members.groupBy("form", "exact").agg(F.min(key).alias("variant_id"), F.count(F.lit(1)).alias("n")), "variants")
    classes = variants.groupBy("form").agg(F.min("variant_id").alias("class_id"), F.sum("n").alias("total"))
    sized = variants.join(classes, "form").select("form", "exact", "variant_id", "class_id", (F.col("total") - F.col("n")).alias("n_links"))
    return members.join(sized, ["form", "exact"]).select(key, "class_id", "variant_id", "n_links")
