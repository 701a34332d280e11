"""Which texts hold a phrase: a positional index of words, and of q-grams of the different words, searched by the rarest pieces of a phrase.

A text that holds a phrase has the phrase's inner words as whole words, before them a word that ends with the phrase's first and
after them one that begins with its last (or, of a phrase that is one word, a word that contains it). So texts are indexed by their
words and places, and only the different words by the q-grams in them, with signs at their ends. Phrases with enough inner words are
looked up by these alone; the pieces at the ends of shorter ones are found in the vocabulary by their rarest q-grams. The words of a
piece tell how often it occurs at most; and a phrase meets only the texts that have its rarest pieces, at places that fit each
other. Texts are compared with phrases at the end, so the index never decides alone.

Texts are written once, as several passes read them, and so is the vocabulary. Places are told while the texts are read, and only
those of words that some phrase asks for leave the task. Sides that are small as written are broadcast by Spark itself; the others are shuffled by word, q-gram or id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.sources.staging import staged, staged_in_blocks

#: Characters of a q-gram; q-grams that a piece is looked up with, pieces that a phrase is looked up with; signs for a word's ends.
Q, RAREST_GRAMS, RAREST_PIECES, HEAD, TAIL = 3, 3, 3, "\x02", "\x03"
#: Bytes of a row group of the texts.
BLOCK_BYTES = 4 << 20


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, "\\s+"), lambda w: w != "")


def runs(c: Column, k: int) -> Column:
    """The different runs of k characters."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


@dataclass
class TextIndex:
    """texts: (evidence, text); vocabulary: (word, n): the different words and how often each occurs."""

    texts: DataFrame
    vocabulary: DataFrame

    def places(self) -> DataFrame:
        """(evidence, at, word): every word with its place."""
        return self.texts.select("evidence", F.posexplode(words_of(F.col("text"))).alias("at", "word"))


def text_index(texts: DataFrame) -> TextIndex:
    """The index of texts (evidence, text), in the shared folder. Null and blank texts hold nothing."""
    own = staged_in_blocks(texts.select("evidence", "text").where(F.col("text").isNotNull()), "texts", BLOCK_BYTES)
    words = own.select(F.explode(words_of(F.col("text"))).alias("word"))
    return TextIndex(own, staged(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "vocabulary"))


def pieces_of(phrases: DataFrame) -> DataFrame:
    """(claim, i, piece, kind) of phrases (claim, text): inner words whole, and where they are fewer than RAREST_PIECES the first as an end
    and the last as a beginning; the word of a phrase of one as a part."""
    split = phrases.select("claim", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = split.select("claim", F.size("w").alias("n"), F.posexplode("w").alias("i", "piece"))
    kind = F.when(F.col("n") == 1, "part").when(F.col("i") == 0, "end").when(F.col("i") == F.col("n") - 1, "start").otherwise("whole")
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    return each.where(inner | (F.col("n") < RAREST_PIECES + 2)).select("claim", "i", "piece", kind.alias("kind"))


def words_with(pieces: DataFrame, index: TextIndex) -> DataFrame:
    """(piece, kind, word, n): the words of the vocabulary that each different piece (piece, kind) may stand for.

    Whole words are looked up as they are. The others bring q-grams, an end or a beginning with the sign of the word's end; the
    vocabulary's words give theirs, those of no piece are dropped at once, and a piece meets the words that have all its rarest ones."""
    different = pieces.distinct()
    whole = different.where("kind = 'whole'").join(index.vocabulary.withColumn("piece", F.col("word")), "piece").select("piece", "kind", "word", "n")
    signed = F.when(F.col("kind") == "end", F.concat("piece", F.lit(TAIL))).when(F.col("kind") == "start", F.concat(F.lit(HEAD), "piece")).otherwise(F.col("piece"))
    loose = different.where("kind <> 'whole'").withColumn("signed", signed)
    asked = loose.withColumn("gram", F.explode(F.when(F.length("signed") < Q, F.array("signed")).otherwise(runs(F.col("signed"), Q))))
    lengths = asked.agg(F.collect_set(F.length("gram"))).first()[0]  # at most Q of them
    if not lengths:
        return whole
    word = F.concat(F.lit(HEAD), "word", F.lit(TAIL))
    grams = index.vocabulary.select("word", "n", F.explode(F.concat(*(runs(word, k) for k in sorted(lengths)))).alias("gram"))
    grams = staged(grams.join(asked.select("gram").distinct(), "gram", "left_semi"), "grams")
    seen = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    of_piece = Window.partitionBy("piece", "kind")  # the q-grams of a piece
    ranked = asked.join(seen, "gram", "left").withColumns({"k": F.row_number().over(of_piece.orderBy("words", "gram")), "there": F.min(F.col("words").isNotNull()).over(of_piece), "all": F.count(F.lit(1)).over(of_piece)})
    wanted = ranked.where(F.col("there") & (F.col("k") <= RAREST_GRAMS)).select("piece", "kind", "signed", "gram", F.least("all", F.lit(RAREST_GRAMS)).alias("needed"))
    both = grams.join(wanted, "gram").groupBy("piece", "kind", "signed", "needed", "word", "n").agg(F.count(F.lit(1)).alias("found")).where("found = needed")
    return whole.unionByName(both.where(F.contains(F.concat(F.lit(HEAD), "word", F.lit(TAIL)), F.col("signed"))).select("piece", "kind", "word", "n"))


def candidates(phrases: DataFrame, index: TextIndex) -> DataFrame:
    """(claim, evidence): the texts that have the rarest pieces of a phrase at places that fit; all that hold it are among them."""
    pieces = staged(pieces_of(phrases), "pieces")
    words = staged(words_with(pieces.select("piece", "kind"), index), "words")
    weight = words.groupBy("piece", "kind").agg(F.sum("n").alias("n"))
    of_phrase = Window.partitionBy("claim")  # the pieces of a phrase
    ranked = pieces.join(weight, ["piece", "kind"], "left").withColumns({"k": F.row_number().over(of_phrase.orderBy("n", "i")), "there": F.min(F.col("n").isNotNull()).over(of_phrase), "all": F.count(F.lit(1)).over(of_phrase)})
    chosen = ranked.where(F.col("there") & (F.col("k") <= RAREST_PIECES)).select("claim", "i", "piece", "kind", F.least("all", F.lit(RAREST_PIECES)).alias("needed"))
    keys = chosen.join(words, ["piece", "kind"]).select("claim", "needed", "i", "word")
    met = index.places().join(staged(keys, "keys"), "word").select("claim", "evidence", "needed", (F.col("at") - F.col("i")).alias("start"))
    return met.groupBy("claim", "evidence", "needed", "start").agg(F.count(F.lit(1)).alias("found")).where("found = needed").select("claim", "evidence").distinct()


def held(phrases: DataFrame, index: TextIndex) -> DataFrame:
    """(claim, evidence) where the text of the evidence holds the phrase (claim, text). Equal phrases are looked up once; blank ones are
    held nowhere."""
    own = phrases.where(F.size(words_of(F.col("text"))) > 0)
    different = staged(own.select("text").distinct(), "phrases").select(F.col("text").alias("claim"), "text")
    if different.isEmpty():
        return phrases.sparkSession.createDataFrame([], T.StructType([own.schema["claim"], index.texts.schema["evidence"]]))
    pairs = staged(candidates(different, index), "candidates")
    found = index.texts.join(pairs, "evidence").where(F.contains("text", F.col("claim"))).select(F.col("claim").alias("text"), "evidence")
    return own.join(found, "text").select("claim", "evidence")
