"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are read as Arrow batches and re-cut into batches of about equal bytes,
so a run of long documents never forms one huge call. A long text is split
where no token of the vocabulary can cross, and the lengths of its parts are
added; nothing else leaves the Python worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
give repeated rows; a null id stays null; other columns of the input are not
read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes

BATCH_BYTES = 1 << 20  # text handed to the encoder at once
SPLIT_BYTES = 1 << 14  # a longer text is cut at safe boundaries
TOKEN_LIMIT = 4096

_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def safe_cut(pieces: list[str], encode: Callable[[str], list[int]]) -> bool:
    """Whether a text may be cut at a single space between printable ASCII characters.

    True if no piece has its word mark after another character (so nothing
    merges across the cut) and the encoder itself puts one mark before a text,
    which stands for the space dropped at the cut.
    """
    mark = "▁"
    if any(re.search(f"[^{mark}]{mark}", p) for p in pieces):
        return False
    return encode("a a") == encode("a") * 2


#: Neither side can be changed by the other through normalisation or joined with the space.
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


def parts(text: str, limit: int) -> list[str]:
    """Parts of ``limit`` characters or a little more, cut at safe spaces, which are dropped."""
    out, at = [], 0
    while len(text) - at > limit and (m := CUT.search(text, at + limit)):
        out.append(text[at:m.start()])
        at = m.end()
    out.append(text[at:])
    return out


def encoder(name: str, model: bytes) -> Callable[[list[str]], list[int]]:
    """Texts -> their token counts. ``.model`` files go to sentencepiece, ``.json`` files to tokenizers."""
    key = hashlib.sha256(model).hexdigest()
    if key in _LOADED:
        return _LOADED[key]
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        cuttable = safe_cut([sp.id_to_piece(i) for i in range(sp.get_piece_size())], lambda s: sp.encode(s))

        def count(texts: list[str]) -> list[int]:
            flat, owner = [], []
            for i, t in enumerate(texts):
                own = parts(t, SPLIT_BYTES) if cuttable and len(t) > SPLIT_BYTES else [t]
                flat += own
                owner += [i] * len(own)
            n = [0] * len(texts)
            for i, ids in zip(owner, sp.encode(flat, num_threads=1)):
                n[i] += len(ids)
            return n
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model.decode())
        tok.no_truncation()
        tok.no_padding()

        def count(texts: list[str]) -> list[int]:
            return [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    _LOADED[key] = count
    return count


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = TOKEN_LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row. The vocabulary file (a few hundred KB) travels with the task."""
    with open(model_path, "rb") as f:
        model = f.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(model_path, model)
        for b in by_bytes(batches, 1, batch_bytes):
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = lengths(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return src.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
