"""Byte-level BPE over a corpus: each distinct pre-token of the corpus is encoded once.

Documents are cut into pre-tokens, whose positions stay with their block of documents as numbers of the block's distinct
words. The distinct words are shuffled by hash; the task of a bucket encodes each word once, whatever the number of blocks
that have it, and sends the ids back; the block puts them in the order of the positions. Decoding is a map-side join of the
ids with the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from placeledger.llm import blocks
from placeledger.llm.texts import slices, with_text_key

BLOCK_BYTES = 6 << 20
#: Pre-tokens of a block that are put together at once.
STEP = 1 << 19
#: No pre-token crosses the gap between two characters other than white space if the second follows a single space.
GAPS = re.compile(r"(?<=\S)(?= \S)")


def vocabulary(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: base64 of the bytes, a space, the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _cut_block(texts: list[str], find) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, their numbers in the order of the texts, and how many each text has."""
    words: dict[str, int] = {}
    inner: dict[str, bytes] = {}
    whole: dict[str, bytes] = {}

    def numbers(piece: str) -> bytes:
        return np.array([words.setdefault(w, len(words)) for w in find(piece)], "<u4").tobytes()

    out = []
    for text in texts:
        head, *rest = text.split(" ")
        simple = not rest or (head != "" and not head[-1].isspace())
        if simple:
            for part in rest:
                if part not in inner:
                    if part == "" or part[0].isspace() or part[-1].isspace():
                        simple = False
                        break
                    inner[part] = numbers(" " + part)
        if simple:
            out.append(numbers(head) + b"".join(map(inner.__getitem__, rest)))
            continue
        pieces = GAPS.split(text)
        for piece in pieces:
            if piece not in whole:
                whole[piece] = numbers(piece)
        out.append(b"".join(map(whole.__getitem__, pieces)))
    return list(words), np.frombuffer(b"".join(out), "<u4"), np.array([len(x) // 4 for x in out], dtype=np.int64)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, one row for each row of ``docs``.

    Each match of ``pattern`` is encoded alone, by the ranks in ``vocabulary_path``; there are no special tokens. A null or
    empty text has no ids. Rows may repeat and ids may be null; other columns are not read.
    """
    spark = docs.sparkSession
    n = blocks.buckets(spark)
    ranks = spark.sparkContext.broadcast(vocabulary(vocabulary_path))

    def make(batches):
        find, k = regex.compile(pattern).findall, 0
        for batch in batches:
            texts = batch.column("text")
            for row, _, offsets in slices(texts, block_bytes):
                count = len(offsets) - 1
                words, numbers, counts = _cut_block([x or "" for x in texts.slice(row, count).to_pylist()], find)
                # Frequent words get small numbers, which compress better.
                often = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
                rank = np.empty(len(often), dtype=np.int32)
                rank[often] = np.arange(len(often))
                words, numbers = [words[i] for i in often.tolist()], rank[numbers]
                block = blocks.block_number(k)
                k += 1
                raw = [w.encode() for w in words]
                bucket = np.array([zlib.crc32(w) % n for w in raw], dtype=np.int64)
                ids = batch.column("doc_id").slice(row, count)
                own = blocks.pack(
                    np.asarray(ids.fill_null(0)), np.asarray(ids.is_null(), dtype=bool) if ids.null_count else np.zeros(count, bool),
                    counts, blocks.least(bucket), blocks.least(np.array([len(w) for w in raw], dtype=np.int64)),
                    np.frombuffer(b"".join(raw), np.uint8), *blocks.planes(numbers),
                )
                del words, numbers, raw
                yield blocks.asked([(block, 0, own)])
                blocks.give_back()

    def ask(batches):
        for block, payload in blocks.payloads(batches):
            bucket, lengths, data = blocks.unpack(payload)[3:6]
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            raw = data.tobytes()
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                some = order[edges[b] : edges[b + 1]]
                words = b"".join(raw[i:j] for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True))
                rows.append((block, int(b), blocks.pack(lengths[some], np.frombuffer(words, np.uint8))))
            yield blocks.asked(rows)

    def answer(questions):
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        out = []
        for block, payload in questions:
            lengths, data = blocks.unpack(payload)
            raw, ends = data.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
            found = []
            for a, b in zip([0, *ends], ends):
                word = raw[a:b]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encoder._encode_single_piece(word)
                found.append(ids)
            out.append((block, blocks.pack(blocks.least(np.array([len(x) for x in found])), blocks.least(np.array([i for x in found for i in x])))))
        return out

    def assemble(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            raise RuntimeError("words of a block that is not there")
        ids, null, counts, bucket, _, _, *numbers = blocks.unpack(own.column("payload")[0].as_py())
        numbers = blocks.from_planes(numbers)
        got = [blocks.unpack(p) for _, p in sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))]
        sizes, tokens = (np.concatenate([x[k].astype(np.int64) for x in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        place = np.empty(len(bucket), dtype=np.int64)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        flat, edges = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        doc, base = 0, 0
        while doc < len(counts):
            until = max(doc + 1, int(np.searchsorted(bounds, bounds[doc] + STEP, "right")) - 1)
            at = place[numbers[bounds[doc] : bounds[until]]]
            lengths = sizes[at]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            flat.append(tokens[np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])].astype(np.int32))
            edges.append(base + ends[bounds[doc + 1 : until + 1] - bounds[doc]])
            doc, base = until, base + int(ends[-1])
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null),
            "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(edges), pa.int32()), pa.array(np.concatenate(flat), pa.int32())),
        })

    made = with_text_key(docs).select("doc_id", "text").mapInArrow(make, blocks.ASKED)
    # Shuffled once, by block, and read twice: for the questions and, with the answers, for the result.
    dealt = made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    answers = blocks.answered(dealt.mapInArrow(ask, blocks.ASKED), answer)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes of the ids; a null list has no bytes, an unknown id is an error."""
    table = {i: b for b, i in vocabulary(vocabulary_path).items()}
    known = encoded.sparkSession.sparkContext.broadcast([table.get(i) for i in range(max(table) + 1)])

    def join(batches):
        of = pa.array(known.value, pa.large_binary())
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column("ids")), 0)), dtype=np.int64)
            row = 0
            while row < batch.num_rows:  # rows of some STEP ids, or one row of more
                before = int(ends[row - 1]) if row else 0
                until = max(row + 1, int(np.searchsorted(ends, before + STEP, "right")))
                some = batch.slice(row, until - row)
                bytes_of = of.take(some.column("ids").flatten())
                if bytes_of.null_count:
                    raise ValueError("an id that is not in the vocabulary")
                _, edges, data = bytes_of.buffers()
                edges = np.frombuffer(edges, np.int64, len(bytes_of) + 1) if edges is not None else np.zeros(1, np.int64)
                at = edges[np.concatenate([[0], ends[row:until] - before])].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), until - row, [None, pa.py_buffer(at), data if data is not None else pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("ids"), decoded], names=["doc_id", "ids", "decoded"])
                row = until
            blocks.give_back()

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, ids array<int>, decoded binary")
