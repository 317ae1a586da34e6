"""Byte-level BPE encoding and decoding through a distinct-word table.

Words are split in Spark, each distinct word is encoded once by the tokenizer, and its ids return to the places the
word stands at by a join on chunk and word number (see packets). The ids decode through a join with the id-to-piece
table: `encode` joins those of each chunk's distinct words in Arrow, and `decode` joins given ids in Spark.

Defined cases: a null text is an empty one, with no tokens and the digest of nothing; the special token's string is
one token, as the tokenizer reads it; a document is handled whole, whatever its length; repeated rows and null ids are
allowed, as rows are told apart by their place in a chunk; an empty table gives an empty result; columns of any other
name and type are ignored, or carried as they are if `keep` names them.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packets import answered, chunked, finished


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_tokenizer(path: str) -> str:
    """The tokenizer's description, without truncation and padding; executors get it from the driver."""
    with open(path, encoding="utf-8") as file:
        return json.dumps(json.load(file) | {"truncation": None, "padding": None})


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def pieces(description: str) -> list[bytes]:
    """The bytes of every id."""
    spec, back = json.loads(description), byte_alphabet()
    by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [bytes(back[c] for c in by_id[i]) if i in by_id else b"" for i in range(max(by_id) + 1)]


def encoder(description: str) -> Callable[[pa.Array], pa.ListArray]:
    """A function from distinct words to their ids; it makes the tokenizer where it runs."""

    def answer(words: pa.Array, rows: int = 10_000) -> pa.ListArray:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, ids = Tokenizer.from_str(description), []
        for start in range(0, len(words), rows):  # an encoding is much larger than its ids
            ids.append(pa.array([e.ids for e in tokenizer.encode_batch(words.slice(start, rows).to_pylist(), add_special_tokens=False)], pa.list_(pa.int32())))
        return pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32()))

    return answer


def joined_pieces(lists: pa.ListArray, table: pa.Table, rows: int = 50_000) -> list[bytes]:
    """The bytes of each list of ids, by a join with the id-to-piece table (id, piece), so many lists at a time."""
    out: list[bytes] = []
    for start in range(0, len(lists), rows):
        part = lists.slice(start, rows)
        ids, ends = part.flatten(), np.cumsum(np.asarray(pc.list_value_length(part)))
        flat = pa.table({"id": ids, "at": pa.array(np.arange(len(ids)))})
        found = flat.join(table, "id", join_type="left outer", use_threads=False).sort_by("at")["piece"].combine_chunks()
        out += pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), found), pa.scalar(b"", pa.binary())).to_pylist()
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def read_back(data: bytes) -> str:
    """Bytes that aren't UTF-8 decode as the replacement character."""
    return data.decode("utf-8", errors="replace")


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), per_chunk: int = 4_000_000) -> DataFrame:
    """The columns in `keep` and those in `outputs`: n_tokens, ids (array<int>), decoded, ids_sha256, decoded_sha256.

    `per_chunk` words bound what a task holds at once, besides a single longer text.
    """
    description = read_tokenizer(vocabulary)
    by_id = pieces(description)
    shared = docs.sparkSession.sparkContext.broadcast((np.arange(len(by_id), dtype=np.int32), by_id))
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def finish(lists: pa.ListArray) -> Callable[[np.ndarray, np.ndarray], list[pa.Array]]:
        flat, length = np.asarray(lists.flatten()), np.asarray(pc.list_value_length(lists)).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(length)))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat).cast(pa.string())), ",")
        texts = np.array(texts.to_pylist(), dtype=object)
        wanted = {"decoded", "decoded_sha256"} & set(outputs)
        ids, by_piece = shared.value
        piece = np.array(joined_pieces(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat)), pa.table({"id": pa.array(ids), "piece": pa.array(by_piece, pa.binary())})), dtype=object) if wanted else None

        def make(value: np.ndarray, first: np.ndarray) -> list[pa.Array]:
            n, out = len(first) - 1, {}
            count = np.concatenate(([0], np.cumsum(length[value]))) if len(value) else np.zeros(1, np.int64)
            out["n_tokens"] = pa.array(count[first[1:]] - count[first[:-1]], pa.int64())
            if "ids" in outputs:
                within = np.arange(int(count[-1])) - np.repeat(count[:-1], length[value])
                out["ids"] = pa.ListArray.from_arrays(pa.array(count[first], pa.int32()), pa.array(flat[within + np.repeat(starts[:-1][value], length[value])].astype(np.int32)))
            if "ids_sha256" in outputs:
                own = texts[value].tolist()
                out["ids_sha256"] = pa.array([sha(",".join(own[first[i] : first[i + 1]]).encode()) for i in range(n)], pa.string())
            if wanted:
                own = piece[value].tolist()
                read = [read_back(b"".join(own[first[i] : first[i + 1]])) for i in range(n)]
                out["decoded"], out["decoded_sha256"] = pa.array(read, pa.string()), pa.array([sha(x.encode()) for x in read], pa.string())
            return [out[c] for c in outputs]

        return make

    chunks = chunked(docs, text_col, keep, per_chunk)
    names = [f"__{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), *(f"{c} {kinds[c]}" for c in outputs)])
    out = finished(chunks, answered(chunks, encoder(description)), finish, schema, [*names, *outputs])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *outputs)


def decode(encoded: DataFrame, vocabulary: str, key_col: str, ids_col: str = "ids") -> DataFrame:
    """(key_col, text) from ids, by a join with the id-to-piece table; an empty or null list gives an empty text.

    key_col has to tell the rows apart.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pieces(read_tokenizer(vocabulary)))], "id int, piece binary")
    places = encoded.select(F.col(key_col).alias("key"), F.posexplode(ids_col).alias("at", "id")).join(F.broadcast(table), "id")
    texts = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("hex")))).alias("p"))
    text = F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), ""))
    found = texts.select("key", F.try_validate_utf8(text.cast("string")).alias("text"), F.make_valid_utf8(text.cast("string")).alias("repaired"))
    return encoded.select(F.col(key_col)).join(found, F.col(key_col) == F.col("key"), "left").select(key_col, F.coalesce("text", "repaired", F.lit("")).alias("text"))


def op2_bpe(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode(docs, vocabulary or default_vocabulary())
