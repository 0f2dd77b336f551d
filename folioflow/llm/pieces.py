"""SentencePiece encoding and decoding by a relational lattice.

A text is normalised (a leading space, spaces written as ``▁``) and cut before every run of ``▁``; no
piece reaches over such a cut, which ``Vocabulary`` checks, so words can be encoded one by one. The
lattice of a word is relational: substrings of bounded length are exploded, joined by equality to the
piece table and grouped by word, and a Spark higher-order ``aggregate`` folds the edges. For a unigram
model the fold is Viterbi's (``fold_viterbi``). The public vocabulary is a BPE model, where the path of
greatest score is not the model's answer; there the fold applies the model's rule to the same edges: the
best-scored adjacent pair merges first, the leftmost of equals (``fold_merges``).

The corpus's frequent words, counted over all texts, each over 1 / ``FREQUENT`` of all words, go through
that lattice and become a broadcast dictionary of bounded size (below FREQUENT words of at most ``LONGEST``
code points). Texts are then encoded in place, batch by batch; a word outside the dictionary is encoded
where it stands by the same merge rule over the same pieces (``Vocabulary.merge``), so no word is lost and
no text or token is shuffled: a join of every word of every text to the table of all distinct words would
write several times the input. Words longer than LONGEST take a heap, n log n in their length.

Defined cases: a null or empty text has no pieces and decodes to the empty text; characters without a
piece become their UTF-8 bytes' pieces; ``▁`` in a text is a space; repeated rows get equal pieces;
control pieces never match text.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from folioflow.llm.common import cut, scratch, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORDS = f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
FREQUENT = 100_000
LONGEST = 48
CACHE = 150_000  # a worker remembers up to twice as many words beside the dictionary
_INF = 1e300


class Vocabulary:
    """The pieces of a model file: (piece, id, score), byte pieces apart."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, self.pieces, self.bytes, self.texts = path, {}, [0] * 256, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.texts.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append(b"")
            else:
                self.pieces[piece] = (model.get_score(i), i)
                self.texts.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.pieces))
        self.scores = {p: s for p, (s, _) in self.pieces.items()}
        if any(not re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in self.pieces):
            raise ValueError("a piece reaches over the start of a word")

    def ids(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            known = self.pieces.get(s)
            out += [known[1]] if known else [self.bytes[b] for b in s.encode("utf-8", "replace")]
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of a word: the best-scored adjacent pair merges first, the leftmost of equals."""
        if len(word) > LONGEST:
            return self._merge_long(word)
        score, parts = self.scores.get, list(word)
        pairs = [score(a + b, -_INF) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == -_INF:
                break
            at = pairs.index(best)
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joined]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(joined + parts[at + 1], -_INF)
            if at:
                pairs[at - 1] = score(parts[at - 1] + joined, -_INF)
        return self.ids(parts)

    def _merge_long(self, word: str) -> list[int]:
        n, pieces = len(word), self.pieces
        parts: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                joined = parts[i] + parts[j]
                found = pieces.get(joined) if len(joined) <= self.longest else None
                if found:
                    heapq.heappush(heap, (-found[0], i, j, joined))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return self.ids([p for p in parts if p is not None])


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """piece, id, score: as many rows as the vocabulary has pieces."""
    rows = [(p, i, float(s)) for p, (s, i) in vocabulary.pieces.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def words_of(text: Column) -> Column:
    normal = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(F.length(text) > 0, F.regexp_extract_all(normal, F.lit(WORDS), F.lit(0)))


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word and edges (start, len, score, id) of every word of ``words`` (distinct): the pieces that its
    substrings of at most ``longest`` code points are."""
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    rest = F.length("word") - F.col("start") + 1
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(rest, F.lit(longest)))).alias("len"))
    parts = spans.withColumn("piece", F.substr("word", F.col("start"), F.col("len")))
    edges = parts.join(F.broadcast(pieces), "piece")  # the vocabulary: of fixed size
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("start", "len", "score", "id"))).alias("edges"))
    return words.join(grouped, "word", "left").select("word", F.coalesce("edges", F.expr("cast(array() as array<struct<start:int,len:int,score:double,id:int>>)")).alias("edges"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _byte_ids(word: Column, start: Column, byte_ids: list[int]) -> Column:
    code = F.hex(F.encode(F.substr(word, start, F.lit(1)), "UTF-8"))
    table_ = F.array(*[F.lit(i) for i in byte_ids])
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(code) / 2).cast("int") - 1), lambda k: F.get(table_, F.conv(F.substr(code, (2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))


def fold_merges(words: DataFrame, byte_ids: list[int]) -> DataFrame:
    """word, ids: the edges of each word folded by a BPE model's rule."""
    key = lambda start, size: start * 4096 + size
    known = F.map_from_entries(F.transform("edges", lambda e: F.struct(key(e["start"], e["len"]), F.struct((-e["score"]).alias("cost"), e["id"].alias("id")))))
    first = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(i.alias("s"), F.lit(1).alias("l")))
    words = words.withColumns({"known": known, "symbols": first})
    known = F.col("known")

    def step(state: Column, _: Column) -> Column:
        pairs = F.transform(
            F.slice(state, F.lit(1), F.size(state) - 1),
            lambda x, i: F.struct(F.element_at(known, key(x["s"], x["l"] + F.get(state, i + 1)["l"]))["cost"].alias("cost"), i.alias("i")),
        )
        best = F.array_min(F.filter(pairs, lambda p: p["cost"].isNotNull()))

        def merged(b: Column) -> Column:
            left, right = F.get(state, b["i"]), F.get(state, b["i"] + 1)
            one = F.struct(left["s"].alias("s"), (left["l"] + right["l"]).alias("l"))
            return F.concat(F.slice(state, F.lit(1), b["i"]), F.array(one), F.slice(state, b["i"] + 3, F.size(state)))

        return _let(best, lambda b: F.when(b.isNull(), state).otherwise(merged(b)))

    folded = F.when(F.size("symbols") > 1, F.aggregate(F.sequence(F.lit(2), F.size("symbols")), F.col("symbols"), step)).otherwise(F.col("symbols"))
    named = words.withColumn("folded", folded)
    found = F.transform(
        "folded",
        lambda x: _let(F.element_at(known, key(x["s"], x["l"])), lambda e: F.when(e.isNotNull(), F.array(e["id"])).otherwise(_byte_ids(F.col("word"), x["s"], byte_ids))),
    )
    return named.select("word", F.flatten(found).alias("ids"))


def fold_viterbi(words: DataFrame, byte_ids: list[int], unknown: float) -> DataFrame:
    """word, ids: the path of greatest total score (of equals the one whose last piece is longest); a
    character without a piece costs ``unknown`` and becomes its bytes."""
    none = F.expr("cast(array() as array<int>)")
    state0 = F.array(F.struct(F.lit(0.0).alias("score"), none.alias("ids")))

    def step(state: Column, end: Column) -> Column:
        here = F.filter("edges", lambda e: e["start"] + e["len"] - 1 == end)
        ways = F.transform(here, lambda e: F.struct((F.get(state, e["start"] - 1)["score"] + e["score"]).alias("score"), e["len"].alias("len"), F.concat(F.get(state, e["start"] - 1)["ids"], F.array(e["id"])).alias("ids")))
        byte = F.struct((F.get(state, end - 1)["score"] + unknown).alias("score"), F.lit(1).alias("len"), F.concat(F.get(state, end - 1)["ids"], _byte_ids(F.col("word"), end, byte_ids)).alias("ids"))
        single = F.exists(here, lambda e: e["len"] == 1)
        best = F.array_max(F.when(single, ways).otherwise(F.concat(ways, F.array(byte))))
        return _let(best, lambda b: F.concat(state, F.array(F.struct(b["score"].alias("score"), b["ids"].alias("ids")))))

    folded = F.aggregate(F.sequence(F.lit(1), F.length("word")), state0, step, lambda s: F.element_at(s, -1)["ids"])
    return words.select("word", folded.alias("ids"))


def dictionary(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", frequent: int = FREQUENT) -> dict[str, bytes]:
    """The encoded words that are each over 1 / ``frequent`` of all words: fewer than ``frequent`` of them, of
    at most LONGEST code points, whatever the corpus."""
    spark = docs.sparkSession
    spaced = docs.select(F.explode(F.split(F.col(text), " ", -1)).alias("w")).filter(F.length("w").between(1, LONGEST - 1) & ~F.contains("w", F.lit(SPACE)))
    with scratch():
        often = cut(spaced.groupBy("w").count().filter("count > 1"))  # a word that stands once is over that share only of a corpus of fewer words
        total = often.agg(F.sum("count")).first()[0] or 0
        chosen = cut(often.filter(F.col("count") > total / frequent).select(F.concat(F.lit(SPACE), "w").alias("word")))
        edges = lattice(chosen.repartition("word"), piece_table(spark, vocabulary), vocabulary.longest)
        found = fold_merges(edges, vocabulary.bytes).toArrow()
    return {w: np.array(ids, "<i4").tobytes() for w, ids in zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True)}


class _Encoder(dict):
    """word -> ids as bytes; other words than the dictionary's are encoded as they come, and of those the
    last CACHE to 2 CACHE distinct ones are remembered."""

    def __init__(self, words: dict[str, bytes], vocabulary: Vocabulary):
        super().__init__(words)
        self.vocabulary, self.own, self.older = vocabulary, {}, {}

    def __missing__(self, word: str) -> bytes:
        found = self.own.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = array("i", self.vocabulary.merge(word)).tobytes()
            if len(word) <= LONGEST:
                if len(self.own) >= CACHE:
                    self.own, self.older = {}, self.own
                self.own[word] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        words = re.findall(WORDS, SPACE + text.replace(" ", SPACE)) if text else []
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<i4")


_ENCODERS: dict = {}


def encoder(shared, vocabulary: Vocabulary):
    """A column function that encodes whole texts; one dictionary a worker."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        key = shared.id if hasattr(shared, "id") else id(shared)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = _Encoder(shared.value, vocabulary)
        found = [_ENCODERS[key].encode(t) for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return encode


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with piece_ids."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, vocabulary, text, frequent))
    # marked so that what reads the ids doesn't make Spark compute them a second time
    return docs.withColumn("piece_ids", encoder(_Shared(shared), vocabulary).asNondeterministic()(F.col(text)))


class _Shared:
    """A broadcast with a name that is the same in every task."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` with decoded: the text that the ids spell."""
    texts = vocabulary.texts

    @F.arrow_udf(StringType())
    def spell(lists: pa.Array) -> pa.Array:
        flat, ends, out = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist(), []
        for start, end in zip([0, *ends], ends, strict=False):
            spelled = b"".join(map(texts.__getitem__, flat[start:end].tolist())).decode("utf-8", "replace")
            out.append(spelled[1:] if spelled[:1] == " " else spelled)
        return pa.array(out, pa.string())

    return encoded.withColumn("decoded", spell(F.col(ids)))


def op8_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, a digest of the ids and whether they decode to the text, of every row of ``documents``."""
    vocabulary = Vocabulary(model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(decode(encode(docs, vocabulary), vocabulary))


def digest(decoded: DataFrame) -> DataFrame:
    whole = F.coalesce(F.replace("text", F.lit(SPACE), F.lit(" ")), F.lit(""))
    return decoded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.lower(F.hex(F.xxhash64("piece_ids"))).alias("pieces_xxh64"),
        F.length("decoded").cast("long").alias("n_chars"), (F.col("decoded") == whole).alias("round_trip"),
    )
