"""Language identification with hyperdimensional profiles.

Every letter class has a random bipolar vector of ``DIM`` components.  A trigram
is the bound (elementwise) product of its letters' vectors, the first rotated by
two places and the second by one, so that order matters.  A document is the
bundle (sum) of its trigrams; a language prototype is the bundle of the unit
vectors of the documents that teach it.  A document's language is the prototype
of largest cosine.

Learning is one distributed pass: each task bundles its own documents and emits
one vector per language, and the vectors are added up in a grouped aggregate, so
the driver sees one prototype per value of ``lang``, of which none is left out;
scoring takes ``LANG_BLOCK`` of them at a time.  A bounded sample teaches each
language: documents whose id hash falls under a threshold that gives about
``PER_LANG`` documents for the language (``per_lang``), however large the table;
texts are filtered where they are read, and not shuffled, unless there are more
than ``LANGS_SENT`` languages.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

DIM = 512
SYMBOLS = 64
PER_LANG = 1500
LANG_BLOCK = 1024
LANGS_SENT = 20_000  # shares of so many languages go to every task
SALTS = 64

_cache: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Letter class of every code point: 0 for none, a-z own classes, others share the rest by hash."""
    if "letters" not in _cache:
        table = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
        _cache["letters"] = table
    return _cache["letters"]


def _vectors() -> np.ndarray:
    if "vectors" not in _cache:
        bits = kernel.stream(77, SYMBOLS * DIM) >> np.uint64(63)
        _cache["vectors"] = (bits.astype(np.int8) * 2 - 1).reshape(SYMBOLS, DIM)
    return _cache["vectors"]


def encode(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of each document of a block (zero if it has no letter), and whether it has a letter."""
    docs = len(offs) - 1
    points, at = kernel.code_points(buf, offs)
    # each document becomes: blank, its symbols, blank; runs of non-letters count once
    symbols = np.zeros(len(points) + 2 * docs, dtype=np.int64)
    place = np.arange(len(points)) + np.repeat(2 * np.arange(docs) + 1, np.diff(at))
    symbols[place] = _letters()[points]
    owner = np.repeat(np.arange(docs), np.diff(at) + 2)
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[keep], owner[keep]
    if len(symbols) < 3:
        return np.zeros((docs, DIM), np.float32), np.zeros(docs, bool)
    code = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    same = (owner[2:] == owner[:-2]) & (symbols[1:-1] != 0)
    code, owner = code[same], owner[:-2][same]
    used = np.flatnonzero(np.bincount(code, minlength=1)) if len(code) else np.zeros(0, np.int64)
    v = _vectors()
    out = np.zeros((docs, DIM), np.float32)
    slot = np.zeros(SYMBOLS**3, np.int64)
    for lo in range(0, len(used), 8192):
        part = used[lo : lo + 8192]
        slot[:] = -1
        slot[part] = np.arange(len(part))
        grams = np.roll(v, 2, axis=1)[part // SYMBOLS**2] * np.roll(v, 1, axis=1)[part // SYMBOLS % SYMBOLS] * v[part % SYMBOLS]
        grams = grams.astype(np.float32)
        own = slot[code]
        sel = own >= 0
        for d in range(0, docs, 256):
            here = sel & (owner >= d) & (owner < d + 256) if docs > 256 else sel
            n = min(256, docs - d)
            counts = np.bincount((owner[here] - d) * len(part) + own[here], minlength=n * len(part))
            out[d : d + n] += counts.reshape(n, len(part)).astype(np.float32) @ grams
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    lettered = np.bincount(owner, minlength=docs)[:docs] > 0
    return out / np.maximum(norm, 1e-9), lettered


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> dict[str, list[float]]:
    """Prototype of every non-null lang of docs (doc_id, text, lang)."""
    docs = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    share = docs.groupBy("lang").count().select("lang", F.ceil(F.lit(float(per_lang) * (1 << 20)) / F.col("count")).alias("below"))
    few = share.limit(LANGS_SENT + 1).collect()
    if len(few) <= LANGS_SENT:
        small = F.broadcast(docs.sparkSession.createDataFrame(few, share.schema))
        chosen = docs.join(small, "lang")
    else:
        # too many to send: a join by language, each of them dealt over SALTS tasks
        salt = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")
        salted = share.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        chosen = docs.withColumn("salt", salt).join(salted, ["lang", "salt"]).drop("salt")
    sample = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("below"))

    def bundle(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for b in kernel.blocks(batch.column("text")):
                vectors, _ = encode(b.buf, b.offs)
                for lang, v in zip(langs[b.lo : b.hi], vectors):
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "v": pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))})

    parts = sample.select("text", "lang").mapInArrow(bundle, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.transform("v", lambda p: p["x"]).alias("v"))
    return {r["lang"]: r["v"] for r in whole.collect()}  # DIM numbers for each value of lang


def predict(docs: DataFrame, prototypes: dict[str, list[float]]) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs.

    Null or letterless texts give ``und`` and 0; so does every row if nothing was
    learned.  Rows are judged one by one: repeated rows give repeated results, a
    null doc_id is passed through, other columns are ignored.
    """
    langs = sorted(prototypes)
    table = np.array([np.array(prototypes[k]) / max(np.linalg.norm(prototypes[k]), 1e-9) for k in langs], np.float32).reshape(len(langs), DIM)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc_id")
            for b in kernel.blocks(batch.column("text")):
                vectors, lettered = encode(b.buf, b.offs)
                if langs:
                    best, top = np.zeros(len(vectors), np.int64), np.full(len(vectors), -2, np.float32)
                    for lo in range(0, len(langs), LANG_BLOCK):
                        cos = vectors @ table[lo : lo + LANG_BLOCK].T
                        at = cos.argmax(axis=1)
                        better = cos[np.arange(len(at)), at] > top
                        best[better], top[better] = at[better] + lo, cos[np.arange(len(at)), at][better]
                    score = np.where(lettered, np.clip(top, 0, 1), 0.0)
                    pred = [langs[i] if ok else "und" for i, ok in zip(best, lettered)]
                else:
                    score, pred = np.zeros(len(vectors)), ["und"] * len(vectors)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(b.lo, b.hi - b.lo), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.round(score, 6).astype(np.float64))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, held_out_of: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from the rows whose crc32 bucket is not ``held_out``, then predict every row."""
    prototypes = learn(docs.filter(kernel.crc_bucket(F.col("doc_id"), held_out_of) != held_out))
    found = predict(docs, prototypes)
    return found.select("doc_id", (kernel.crc_bucket(F.col("doc_id"), held_out_of) == held_out).alias("held_out"), "lang_pred", "score")
