"""Fill-in-middle transformation over a piece table.

Two buffers never change: the text's own bytes and the sentinels
(``<P><S><M>``). A document is a list of descriptors (buffer, start, end).
Cutting splits the descriptor at each of two places; an arrangement is a
permutation of the three parts with a sentinel descriptor before each; the
inverse permutation of the parts found in an output restores the document.
Hashes run over the descriptors' slices, so no rearranged text is made
unless it is asked for.

A text's units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``,
read from the left; as white space is ASCII, a unit ends where a byte that is
none meets one that is, and at the end. h1 to h4 are the first four 8-digit
groups of the hex SHA-256 of ``<seed>:<id>``. Of n units the prefix has the
smaller of h1 % (n+1) and h2 % (n+1), prefix and middle together the larger.

Forms: ``plain`` (the text as it is) if the text is empty or has a sentinel in
it, or if h3 % 100 >= ``fim_percent``; else ``spm`` if h4 % 100 <
``spm_percent``, else ``psm``:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle

Texts with sentinels stay plain, and no sentinel can arise where two parts
meet, so the first of each sentinel in an output is the one that was put there.

A null text counts as empty, a null id is spelled ``null``. Rows are
transformed each for itself: repeated rows and equal ids give equal results,
an empty table an empty one. There is no shuffle; a task holds one Arrow batch
and the marks of one text (a byte per byte).
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import prepare, text_of

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
# Parts of the document (0 prefix, 1 middle, 2 suffix) in the order of each form, and the sentinel before each part.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
SENTINEL_OF_PART = (PREFIX, MIDDLE, SUFFIX)
TEXT, MARKS = 0, 1
# Rows handled at once, so that what is made of them stays small.
ROWS_AT_ONCE = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class PieceTable:
    """Descriptors over a text's bytes and the sentinels."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, text, pieces: list[tuple[int, int, int]] | None = None) -> None:
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def _with(self, pieces: list[tuple[int, int, int]]) -> PieceTable:
        return PieceTable(self.buffers[TEXT], pieces)

    def cut(self, places: tuple[int, ...]) -> list[PieceTable]:
        """The parts before, between and after the places (byte counts from the start, ascending)."""
        parts, at, left = [], 0, list(self.pieces)
        for place in places:
            part = []
            while left and at < place:
                buffer, start, end = left.pop(0)
                split = min(end, start + place - at)
                part.append((buffer, start, split))
                at += split - start
                if split < end:
                    left.insert(0, (buffer, split, end))
            parts.append(self._with(part))
        return [*parts, self._with(left)]

    @staticmethod
    def joined(parts: list[PieceTable]) -> PieceTable:
        return parts[0]._with([piece for part in parts for piece in part.pieces])

    def sentinel(self, which: bytes) -> PieceTable:
        start = SENTINELS.index(which)
        return self._with([(MARKS, start, start + len(which))])

    def slices(self):
        for buffer, start, end in self.pieces:
            yield self.buffers[buffer][start:end]

    def sha256(self) -> str:
        state = sha256()
        for part in self.slices():
            state.update(part)
        return state.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.slices())

    def characters(self) -> int:
        """Code points: the bytes that do not continue one."""
        return sum(int(np.count_nonzero((np.frombuffer(s, np.uint8) & 0xC0) != 0x80)) for s in self.slices())


def unit_ends(text) -> np.ndarray:
    """Where each unit of the text ends, in bytes."""
    if not len(text):
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(text, np.uint8)]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(text))


def arrange(parts: list[PieceTable], form: str) -> PieceTable:
    """Prefix, middle and suffix in the order of a form, a sentinel before each."""
    return PieceTable.joined([x for p in ORDERS[form] for x in (parts[p].sentinel(SENTINEL_OF_PART[p]), parts[p])])


def restore(output: bytes, form: str) -> PieceTable:
    """The document, as descriptors over an output: the parts between its sentinels, permuted back."""
    if form == "plain":
        return PieceTable(output)
    table, found, at = PieceTable(output), [], 0
    for part in ORDERS[form]:
        at = output.index(SENTINEL_OF_PART[part], at)
        found.append((part, at + len(SENTINEL_OF_PART[part])))
    ends = [start - len(PREFIX) for _, start in found[1:]] + [len(output)]
    inverse = sorted((part, start, end) for (part, start), end in zip(found, ends))
    return table._with([(TEXT, start, end) for _, start, end in inverse])


def transformed(text, doc_id: str, seed: int, fim_percent: int, spm_percent: int) -> tuple[PieceTable, int, str, list[PieceTable]]:
    """(output, units, form, parts) of one text; plain ones have no parts."""
    ends = unit_ends(text)
    n = len(ends)
    digits = sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    table = PieceTable(text)
    if not n or h3 % 100 >= fim_percent or any(s in text for s in SENTINEL_OF_PART):
        return table, n, "plain", []
    form = "spm" if h4 % 100 < spm_percent else "psm"
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = table.cut(tuple(int(ends[k - 1]) if k else 0 for k in (first, second)))
    return arrange(parts, form), n, form, parts


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, its spelling, text as bytes)."""
    doc_id = F.col(f"`{id_col}`")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id.cast("string"), F.lit("null")).alias("spelled"),
        text_of(text_col).cast("binary").alias("text"),
    )


_COMMON = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]


def _mapped(docs: DataFrame, id_col: str, text_col: str, added: list[str], make, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """A row per row: doc_id, units, form, part sizes, and the text columns that ``make(output table, form)`` gives."""
    prepare(docs.sparkSession)
    given = _given(docs, id_col, text_col)
    names = ["doc_id", *[name for name, _ in _COMMON], *added]

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            rows = []
            for spelled, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                output, n, form, parts = transformed(text, spelled, seed, fim_percent, spm_percent)
                sizes = (parts[0].characters(), parts[1].characters()) if parts else (None, None)
                rows.append((n, form, *sizes, *make(output, form)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(added)]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    fields = [T.StructField(n, k) for n, k in [*_COMMON, *[(name, T.StringType()) for name in added]]]
    return given.mapInArrow(run, T.StructType([given.schema["doc_id"], *fields]))


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the transformed texts."""
    make = lambda output, form: (output.bytes().decode(),)
    return _mapped(docs, id_col, text_col, ["output"], make, seed, fim_percent, spm_percent)


def restored(outputs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    prepare(outputs.sparkSession)
    given = outputs.select("*", F.lit(None).cast("string").alias("restored")) if "restored" not in outputs.columns else outputs

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            texts = [
                restore(output.encode(), form).bytes().decode()
                for output, form in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())
            ]
            place = batch.schema.get_field_index("restored")
            yield batch.set_column(place, "restored", pa.array(texts, pa.string()))

    return given.mapInArrow(run, given.schema)


def fim_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): digests of outputs and of what they restore to."""

    def make(output: PieceTable, form: str) -> tuple[str, str]:
        return output.sha256(), restore(output.bytes(), form).sha256()

    return _mapped(docs, id_col, text_col, ["output_sha256", "restored_sha256"], make, SEED, FIM_PERCENT, SPM_PERCENT)


def fim_sql() -> str:
    """The report for DuckDB."""
    unit = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    group = lambda i: f"CAST('0x' || substr(digits, {1 + 8 * i}, 8) AS BIGINT)"
    return rf"""
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{unit}') AS units,
                   sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digits
            FROM documents
        ), drawn AS (
            SELECT *, len(units) AS n, {group(0)} % (len(units) + 1) AS a, {group(1)} % (len(units) + 1) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR {group(2)} % 100 >= {FIM_PERCENT} THEN 'plain'
                        WHEN {group(3)} % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
            FROM units
        ), parts AS (
            SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix,
                   array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
                   array_to_string(units[greatest(a, b) + 1:], '') AS suffix
            FROM drawn
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """
