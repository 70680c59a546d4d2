"""Token ids as flat binary files: unsigned integers one after another, and 64-bit document offsets.

Part ``k`` has ``part-k.ids`` (the ids, little-endian), ``part-k.offsets`` (64-bit, where each document of the part begins,
and the end) and ``part-k.docs`` (64-bit document ids, the smallest number for null). ``index.json`` names the width of an id
and for each part the ids before it: prefix sums of the parts' sizes.
"""

from __future__ import annotations

import gc
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeledger.llm.bpe import GAPS
from placeledger.llm.texts import slices

NULL_ID = -(1 << 63)
#: Parts between single spaces whose ids a worker keeps.
KNOWN_PARTS = 1 << 21
#: New parts that are encoded as one text.
JOINED_PARTS = 128
#: Bytes of text that are encoded at once; a longer text is encoded alone.
BLOCK_BYTES = 8 << 20
#: Ids that a reader hands on at once.
READ_IDS = 1 << 22
_KNOWN: dict[int, tuple[pa.Array, pa.Array]] = {}


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def encoder(tokenizer_json: str, width: str):
    """Many texts to packed ids. Each distinct part of the texts is encoded once while the worker remembers it.

    A text is cut at single spaces between words, which no pre-token crosses (a text with other white space around them is
    cut at :data:`GAPS`). The parts are numbered, looked up and their ids put in order by Arrow. New parts are encoded many at a time
    as one text; each begins with its only space, so the ids whose bytes begin with a space say where they begin.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    vocabulary = tokenizer.get_vocab()
    spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
    spaced[[i for name, i in vocabulary.items() if name.startswith("\u0120")]] = True  # a space, as byte-level vocabularies write it
    size = np.dtype(width).itemsize
    state = hash((tokenizer_json, width))

    def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and where each text begins and ends."""
        gc.disable()  # many short-lived lists, none in a cycle
        ids = [np.array(c.ids, width) for c in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        gc.enable()
        return np.concatenate([np.zeros(0, width), *ids]), np.cumsum([0, *map(len, ids)])

    def packed(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * size).astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])

    def learn(parts: pa.Array) -> pa.Array:
        """The ids of parts without a space or white space around them, each with a space before it."""
        words = parts.to_pylist()
        ids, _ = encoded([" " + " ".join(words[i : i + JOINED_PARTS]) for i in range(0, len(words), JOINED_PARTS)])
        begin = np.flatnonzero(spaced[ids])
        if len(begin) != len(words):  # a vocabulary that writes a space in another way
            return packed(*encoded([" " + w for w in words]))
        return packed(ids, np.append(begin, len(ids)))

    def encode(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The bytes of the ids, and where those of each text begin and end."""
        names, codes = _KNOWN.get(state, (pa.array([], pa.string()), pa.array([], pa.large_binary())))
        if len(names) > KNOWN_PARTS:
            names, codes = names.slice(0, 0), codes.slice(0, 0)
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        edges = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        parts, number = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        loose = np.asarray(pc.or_(pc.equal(parts, ""), pc.not_equal(pc.utf8_trim_whitespace(parts), parts)))[number]
        # A text with white space other than single spaces is put together in one piece; in others, only the head is apart.
        loose_text = np.add.reduceat(loose.astype(np.int64), edges[:-1]) > 0
        own = [[head] for head in parts.take(pa.array(number[edges[:-1]])).to_pylist()]
        for i in np.flatnonzero(loose_text).tolist():
            own[i] = GAPS.split(texts[i].as_py())
        head = np.zeros(len(number), dtype=bool)
        head[edges[:-1]] = True
        rest = ~head & ~np.repeat(loose_text, np.diff(edges))
        used = np.zeros(len(parts), dtype=bool)
        used[number[rest]] = True
        after = parts.filter(pa.array(used)).cast(pa.string())
        at = pc.index_in(after, value_set=names)
        new = after.filter(at.is_null())
        if len(new):
            names, codes = pa.concat_arrays([names, new]), pa.concat_arrays([codes, learn(new)])
            at = pc.index_in(after, value_set=names)
        _KNOWN[state] = names, codes
        # Pieces of a loose text are encoded once for the block.
        pieces = {p: i for i, p in enumerate(dict.fromkeys(p for some in own for p in some))}
        ids, cuts = encoded(list(pieces))
        data, cuts = ids.tobytes(), (cuts * size).tolist()
        of = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        places = np.empty(len(parts), dtype=np.int64)
        places[used] = np.asarray(at)
        number = places[number]
        number[head] = len(codes) + np.arange(len(own))
        keep = rest | head
        out = pa.concat_arrays([codes, pa.array([b"".join([of[pieces[p]] for p in some]) for some in own], pa.large_binary())]).take(pa.array(number[keep]))
        _, ends, data = out.buffers()
        bounds = np.concatenate([[0], np.cumsum(keep)])[edges]
        return memoryview(data if data is not None else b""), np.frombuffer(ends, np.int64)[bounds]

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every whole text, add ``end_id`` to each, and write the ids in ascending order of doc_id under ``path``.

    The tokenizer is a byte-level one whose pre-tokens do not cross a space that a word follows. Strings of special tokens in
    a text are ordinary text. A null text is empty. Null ids come first; rows of one id are ordered by a hash of the text, and equal rows all stay.
    ``path`` must be reachable by all executors. A part is written under a name of its attempt and then renamed, so a task
    that is run again leaves whole files.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    top = max(Tokenizer.from_str(tokenizer_json).get_vocab_size() - 1, end_id)
    width = "<u2" if top < 1 << 16 else "<u4"
    source = spark.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], width).tobytes()
    store, root = _open(path)
    store.create_dir(root, recursive=True)

    def write(batches):
        encode, context = encoder(source.value, width), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = _open(path)
        name = f"{root}/part-{part:05d}"
        sizes, ids = [0], []
        with store.open_output_stream(f"{name}.ids.{attempt}") as out:
            for batch in batches:
                texts = batch.column("text")
                for row, _, offsets in slices(texts, BLOCK_BYTES):
                    data, edges = encode(texts.slice(row, len(offsets) - 1))
                    out.write(b"".join(x for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for x in (data[a:b], end)))
                    sizes += (np.diff(edges) // len(end) + 1).tolist()
                ids.append(np.asarray(batch.column("doc_id").fill_null(NULL_ID)))
        for kind, values in (("offsets", np.cumsum(sizes, dtype="<u8")), ("docs", np.concatenate(ids).astype("<i8") if ids else np.zeros(0, "<i8"))):
            with store.open_output_stream(f"{name}.{kind}.{attempt}") as out:
                out.write(values.tobytes())
        for kind in ("ids", "offsets", "docs"):
            store.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes) - 1], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["part", "docs", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    # One row for each part: what the driver gets does not grow with the documents.
    parts = sorted(dealt.select("doc_id", "text").mapInArrow(write, "part int, docs long, ids long").collect())
    base, index = 0, []
    for part, n_docs, n_ids in parts:
        index.append({"part": part, "docs": n_docs, "ids": n_ids, "base": base})
        base += n_ids
    with store.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps({"width": width, "parts": index}).encode())


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before; ``ids`` are 32-bit little-endian bytes.

    Files of a local or mounted file system are memory-mapped, others are opened by their store.
    """
    store, root = _open(path)
    with store.open_input_stream(f"{root}/index.json") as file:
        index = json.loads(file.read())
    width, parts = index["width"], {p["part"]: p["base"] for p in index["parts"]}

    def read(batches):
        store, root = _open(path)
        local = isinstance(store, fs.LocalFileSystem)

        def values(name: str, kind: str):
            if store.get_file_info(f"{root}/{name}").size == 0:
                return np.zeros(0, kind)
            if local:
                return np.memmap(f"{root}/{name}", dtype=kind, mode="r")
            with store.open_input_file(f"{root}/{name}") as file:
                return np.frombuffer(file.read(), kind)

        for batch in batches:
            for part in batch.column(0).to_pylist():
                ids, offsets, docs = (values(f"part-{part:05d}.{kind}", of) for kind, of in (("ids", width), ("offsets", "<i8"), ("docs", "<i8")))
                row = 0
                while row < len(docs):
                    until = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + READ_IDS, "right")) - 1), len(docs))
                    some, edges = np.asarray(docs[row:until]), np.asarray(offsets[row : until + 1])
                    flat = np.asarray(ids[edges[0] : edges[-1]], dtype="<u4")
                    packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(((edges - edges[0]) * 4).astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int64(), mask=some == NULL_ID), pa.array(edges[:-1] + parts[part]), pa.array(np.diff(edges)), packed],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    row = until

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
