"""Lexical retrieval packing: documents with their BM25 neighbours in sequences of one size.

Documents are tokenised once into a table in the shared folder.  A shard of the inverted index is a run of
that table's rows, of bounded tokens; document frequencies, document count and mean length are those of
the whole table.  In a shard a seed document opens a window, its terms are looked up in the shard's postings, and its
nearest unused documents by BM25 fill the window in order.  The document that reaches the window's end is
cut there and its rest is the next seed; a shard's last rest goes into the next shard.  What a task has
left in the end is cut into powers of two, which need no padding, so no sequence is padded at all.

Inputs: (doc_id, text); other columns are ignored.  A null or empty text is only the end id.  Each row is
a document of its own, also when doc_id or text repeats.  Ties go to the earlier row.  An empty table
gives no pieces.  A retried task reads the same rows and so makes the same pieces.
"""

from __future__ import annotations

import json
import re
import string
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_exact, table, written

K1, B = 1.2, 0.75
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 21
KNOWN_WORDS = 500_000  # cached by a Python worker, for all its tasks; a pipeline of many stages asks for fewer
END = 2  # fixed by the contract


MARKS = string.punctuation  # of ASCII
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Rules by which letters and the marks behind them are tokenised apart, the letters in lower case.
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
MATCHED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer(dict):
    """Whole texts to ids by way of a bounded cache of words (word -> ids).

    The vocabulary's tokens never cross white space, so a text's ids are its words' ids one after another.
    Text is cut at spaces and line feeds only; any other white space stays inside a "word" and is the
    tokenizer's own affair.  Words of Latin letters with marks behind them are put together from the
    lower-cased letters and the marks, which are words in the cache too, if the tokenizer's rules part them
    there; such letters go straight to its model.  The cache has two generations: words that were not met
    in the last one are dropped, frequent ones stay.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        ids = np.arange(1 + max(self.tok.get_vocab().values())).astype(self.dtype).tobytes()
        self.bytes = [ids[k:k + self.dtype.itemsize] for k in range(0, len(ids), self.dtype.itemsize)]
        self.older: dict[str, bytes] = {}
        self.most = KNOWN_WORDS
        self.model = self.tok.model if parts_letters(path) else None
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.learned(word)
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def learned(self, word: str) -> bytes:
        letters = word.rstrip(MARKS)
        plain = letters.isascii()
        if not self.model or not (letters.isalpha() if plain else LETTERS(letters)):
            return b"".join([self.bytes[x] for x in self.tok.encode(word, add_special_tokens=False).ids])
        low = letters.lower()
        if len(low) < len(word):
            return self[low] + self[word[len(low):]]
        if low != word:
            return self[low]
        if not plain:
            low = "".join([x for x, _ in self.level.pre_tokenize_str(low)])
        return b"".join([self.bytes[x.id] for x in self.model.tokenize(low)])

    def encode(self, text: str) -> bytes:
        """The ids, little-endian, of ``dtype``."""
        words = text.replace("\n", " ").split(" ")
        return b"".join(b"".join(map(self.__getitem__, words[s:s + 100_000])) for s in range(0, len(words), 100_000))


def parts_letters(path: str) -> bool:
    """Whether the tokenizer's rules are those by which words of LETTERS with MARKS behind may be put together."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    split, *level = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return ((rules.get("normalizer") or {}).get("normalizers") == LOWERED
            and split.get("type") == "Split" and split["pattern"] == {"Regex": MATCHED}
            and split["behavior"] == "Removed" and split["invert"]
            and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in level] == [("ByteLevel", False, False)]
            and rules["model"].get("type") == "BPE" and not rules.get("post_processor")
            and not any(LETTERS("a" + x["content"].rstrip(MARKS)) for x in rules["added_tokens"]))


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """This process's tokenizer; Spark's Python workers keep it, and its cache, from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenise(docs: DataFrame, tokenizer: str, end: int = END, known_words: int = KNOWN_WORDS) -> DataFrame:
    """(doc_id, tokens): little-endian ids of 2 bytes (4 for a large vocabulary), ``end`` last."""

    def run(batches):
        tok = word_tokenizer(tokenizer)
        tok.most = known_words
        for pdf in batches:
            last = tok.dtype.type(end).tobytes()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [tok.encode(t or "") + last for t in pdf["text"]]})

    return map_exact(docs.select("doc_id", "text"), run, "doc_id long, tokens binary")


def statistics(tokens: DataFrame, dtype: str, vocabulary: int):
    """(document frequency by id, documents, mean length) over all rows of ``tokens``."""

    def run(batches):
        df, n, total = np.zeros(vocabulary, np.int64), 0, 0
        for pdf in batches:
            for raw in pdf["tokens"]:
                ids = np.frombuffer(raw, dtype)
                df[np.unique(ids)] += 1
                n, total = n + 1, total + len(ids)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(at, [-1, -2]), "n": np.append(df[at], [n, total])})

    rows = tokens.select("tokens").mapInPandas(run, "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # at most one row per id of the vocabulary
    by = dict(zip(rows["term"], rows["n"], strict=True))
    df = np.zeros(vocabulary, np.int64)
    at = rows["term"].to_numpy()
    df[at[at >= 0]] = rows["n"].to_numpy()[at >= 0]
    return df, int(by.get(-1, 0)), by.get(-2, 0) / max(by.get(-1, 0), 1)


class Shard:
    """BM25 postings of some documents."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n: int, mean: float):
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.terms, doc, weight = [], [], []
        for k, ids in enumerate(docs):
            t, tf = np.unique(ids, return_counts=True)
            self.terms.append(t.astype(np.int64))
            doc.append(np.full(len(t), k))
            weight.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        term = np.concatenate(self.terms)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = np.concatenate(doc)[order], np.concatenate(weight)[order]
        self.starts = np.searchsorted(term[order], np.arange(len(df) + 1))
        self.n = len(docs)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        lo, hi = self.starts[terms], self.starts[terms + 1]
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def powers(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class Packer:
    """Windows of ``size`` ids, filled with pieces; rows (number, start, length, sequence, offset)."""

    def __init__(self, size: int):
        self.size, self.rows, self.open, self.fill, self.sequence = size, [], [], 0, 0

    def put(self, doc, start: int, length: int) -> bool:
        """Adds a whole document from ``start`` on; True when it ran into a new window."""
        crossed = False
        while length:
            n = min(length, self.size - self.fill)
            self.open.append((doc, start, n))
            self.fill, start, length = self.fill + n, start + n, length - n
            if self.fill == self.size:
                self.close([self.size])
                crossed = True
        return crossed

    def close(self, sizes: list[int]):
        """The open pieces, cut into sequences of ``sizes``."""
        todo = self.open[::-1]
        for size in sizes:
            offset = 0
            while offset < size:
                doc, start, n = todo.pop()
                take = min(n, size - offset)
                self.rows.append((doc, start, take, self.sequence, offset))
                offset += take
                if take < n:
                    todo.append((doc, start + take, n - take))
            self.sequence += 1
        self.open, self.fill = [], 0


def fill_shard(docs: list[np.ndarray], numbers: list[int], packer: Packer, df, n, mean):
    """Every document of the shard goes into the packer, neighbours next to each other."""
    shard = Shard(docs, df, n, mean)
    unused = np.ones(len(docs), bool)
    seed = None
    while unused.any():
        if seed is None:
            seed = int(unused.argmax())
            unused[seed] = False
            if packer.put(numbers[seed], 0, len(docs[seed])) and packer.fill == 0:
                seed = None
                continue
        scores = shard.scores(shard.terms[seed])
        scores[~unused] = -1
        seed = None
        for k in np.argsort(-scores, kind="stable"):
            if scores[k] <= 0:
                break
            unused[k] = False
            if packer.put(numbers[k], 0, len(docs[k])):
                seed = int(k) if packer.fill else None  # its rest opens the next window
                break


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = END, with_ids: bool = False,
         known_words: int = KNOWN_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids)."""
    from tokenizers import Tokenizer
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = written(tokenise(docs, tokenizer, end, known_words), "pack-tokens")
    held = docs.sparkSession.sparkContext.broadcast(statistics(tokens, dtype, vocabulary))

    def run(batches):
        df, n, mean = held.value
        packer, base = Packer(size), TaskContext.get().partitionId() << 40
        ids, arrays, numbers, total = {}, [], [], 0

        def rows():
            out = pd.DataFrame(packer.rows, columns=["doc", "start", "length", "sequence_id", "offset"], dtype="int64")
            packer.rows = []
            raw = [ids[d][1][s:s + k].astype("<u4").tobytes() for d, s, k in
                   zip(out["doc"], out["start"], out["length"], strict=True)]
            out["ids_crc32"] = np.array([zlib.crc32(x) for x in raw], np.int64)
            out["doc_tokens"] = np.array([len(ids[d][1]) for d in out["doc"]], np.int64)
            out["doc_id"] = pd.array([ids[d][0] for d in out["doc"]], "Int64")
            out["sequence_id"] += base
            if with_ids:
                out["ids"] = [np.frombuffer(x, "<i4") for x in raw]
            kept = {d for d, _, _ in packer.open}
            for d in [d for d in ids if d not in kept]:
                del ids[d]
            return out[[x.split()[0] for x in schema.split(", ")]]

        last = 0
        for pdf in batches:
            for i, raw in zip(pdf["doc_id"], pdf["tokens"], strict=True):
                a = np.frombuffer(raw, dtype)
                ids[last] = (i, a)
                arrays.append(a)
                numbers.append(last)
                last, total = last + 1, total + len(a)
                if len(arrays) >= SHARD_DOCS or total >= SHARD_TOKENS:
                    fill_shard(arrays, numbers, packer, df, n, mean)
                    arrays, numbers, total = [], [], 0
                    yield rows()
        if arrays:
            fill_shard(arrays, numbers, packer, df, n, mean)
        packer.close(powers(packer.fill))
        yield rows()

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids array<int>" if with_ids else ""))
    return map_exact(tokens, run, schema)


def op8_packing(spark, sf_dir, tokenizer: str | None = None):
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"),
                tokenizer or public_tokenizers.path("word_bpe_49k.json"))
