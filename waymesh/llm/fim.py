"""Fill-in-the-middle documents, cut at unit boundaries by rank and select on packed bit vectors.

The texts of an Arrow batch lie one after another in one buffer of bytes. A bit vector marks the bytes that end a unit (a
line with its line feed, or the rest after the last one); its words are packed, and a directory keeps the ones before
each block. The number of units of a document is a difference of two ranks; the place where a prefix or a middle ends is
the select of a rank. Nothing is split or scanned again, and cuts never fall inside a character.

Everything random comes from the SHA-256 of seed and doc_id, so a document has the same form wherever it runs.

Defined cases: a null text is the empty text; a text that is empty, or contains one of the markers, stays plain; a null
doc_id hashes as the empty string; repeated rows are alike; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bytes_of, small_batches

#: Words (of 64 bits) in a block of the directory.
BLOCK = 8


@dataclass(frozen=True)
class Forms:
    """How documents are rewritten: how many in a hundred, how many of these with the suffix first, and the markers."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self):
        if len(set(self.markers)) < 3 or any(a in b[1:] or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))) for a in self.markers for b in self.markers):
            raise ValueError("markers must differ and not overlap")


class Boundaries:
    """A bit vector with rank and select."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(-(-len(packed) // (8 * BLOCK)) * BLOCK, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).reshape(-1, BLOCK)
        self.inside = np.cumsum(ones, 1, dtype=np.int64) - ones  # ones of a block before each word
        self.blocks = np.r_[0, np.cumsum(ones.sum(1, dtype=np.int64))]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place (places up to the length)."""
        words = np.r_[self.words, np.uint64(0)][at // 64]
        below = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
        inside = np.r_[self.inside.ravel(), 0][at // 64]
        return self.blocks[at // (64 * BLOCK)] + inside + np.bitwise_count(words & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k ones before it."""
        block = np.searchsorted(self.blocks, k, side="right") - 1
        left = k - self.blocks[block]
        word = block * BLOCK + (self.inside[block] <= left[:, None]).sum(1) - 1
        left = left - self.inside.ravel()[word]
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + ((np.cumsum(bits, 1) == left[:, None] + 1) & (bits == 1)).argmax(1)


def cuts(data: np.ndarray, begin: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, first cut, second cut) of each text; ``begin`` has where texts begin in ``data``, and its end; cuts are places in ``data``."""
    bits = data == 10
    bits[begin[1:][np.diff(begin) > 0] - 1] = True
    marks = Boundaries(bits)
    before = marks.rank(begin)
    n = np.diff(before)
    ends = np.sort(np.stack([hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)]), 0)
    return n, *(np.where(e > 0, marks.select(np.maximum(before[:-1] + e - 1, 0)) + 1 if len(data) else 0, begin[:-1]) for e in ends)


def hashed(doc_id: Column, seed: int) -> Column:
    """Four unsigned integers from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def transform(docs: DataFrame, forms: Forms = Forms()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    small_batches(docs.sparkSession)
    rest = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    p, s, m = (x.encode() for x in forms.markers)

    def rewrite(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, begin = bytes_of(b.column(1))
            hashes = np.stack(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4))
            n, first, second = cuts(data, begin, hashes)
            form, chars, texts = [], [], []
            for i in range(b.num_rows):
                text = data[begin[i] : begin[i + 1]].tobytes()
                if not text or hashes[i, 2] % 100 >= forms.rate or any(x in text for x in (p, s, m)):
                    form.append("plain")
                    chars.append((None, None))
                    texts.append(text)
                    continue
                one, two = first[i] - begin[i], second[i] - begin[i]
                before, middle, after = text[:one], text[one:two], text[two:]
                form.append("spm" if hashes[i, 3] % 100 < forms.suffix_first else "psm")
                chars.append((len(before.decode()), len(middle.decode())))
                texts.append(b"".join((s, after, p, before, m, middle) if form[-1] == "spm" else (p, before, s, after, m, middle)))
            yield batch_of(pa.schema([("doc_id", b.column(0).type), *rest]), b.column(0), n, form, [c[0] for c in chars], [c[1] for c in chars], [t.decode() for t in texts])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", hashed(F.col("doc_id"), forms.seed).alias("h")).mapInArrow(rewrite, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(forms: Forms = Forms(), output: str = "output", form: str = "form") -> Column:
    """The exact text, rebuilt from an output and its form."""
    text, (p, s, m) = F.col(output), forms.markers

    def parted(a: str, b: str) -> tuple[Column, Column, Column]:
        """What stands between the first marker and ``a``, between ``a`` and ``b``, and after ``b``; no part holds a marker."""
        one, two = F.instr(text, a), F.instr(text, b)
        head = len(p if a == s else s)
        return F.substring(text, F.lit(head + 1), one - 1 - head), F.substring(text, one + len(a), two - one - len(a)), F.substring(text, two + len(b), F.length(text))

    before, after, middle = parted(s, m)
    late, early, core = parted(p, m)
    return F.when(F.col(form) == "psm", F.concat(before, middle, after)).when(F.col(form) == "spm", F.concat(early, core, late)).otherwise(text)


def digest_columns(found: DataFrame, forms: Forms = Forms()) -> DataFrame:
    whole = [F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (restored(forms), "restored_sha256"))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *whole)


def oracle(forms: Forms = Forms()) -> str:
    """The digest columns as DuckDB SQL."""
    p, s, m = forms.markers
    part = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{forms.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h,
                      regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units FROM documents),
    e AS (SELECT *, len(units) AS n, least({part(0)} % (len(units) + 1), {part(1)} % (len(units) + 1)) AS a,
                 greatest({part(0)} % (len(units) + 1), {part(1)} % (len(units) + 1)) AS b,
                 CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR {part(2)} % 100 >= {forms.rate} THEN 'plain'
                      WHEN {part(3)} % 100 < {forms.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM d),
    f AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM e)
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{s}' || suf || '{p}' || pre || '{m}' || mid ELSE '{p}' || pre || '{s}' || suf || '{m}' || mid END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM f"""
