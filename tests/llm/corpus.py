"""Small inputs with every awkward case, for the tests of the corpus operators."""

from pyspark.sql import functions as F

ODD = ("h", "fp", "at", "key", "id", "word", "words", "n", "start", "root", "first", "kept", "t", "left", "ats", "starts", "score", "a", "b", "ids", "_at", "_n", "_cut", "row", "cut", "places", "kind")
PASSAGE = " ".join(f"Word{i} of{i} a{i} passage{i} runs." if i % 2 else f"then{i} comes{i} more{i}" for i in range(14))
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog while seven small birds sing in the old tree by the river.", "en"),
    (2, "The quick brown fox jumps over the lazy dog while seven small birds sing in the old tree by the river.", "en"),
    (3, "the Quick brown fox jumps over the lazy dog while seven small birds sing in the old tree by the river!", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, " \n\t ", "en"),
    (7, "one", "en"),
    (8, "12 34 !! ??", "de"),
    (9, LONG, "en"),
    (9, LONG, "en"),
    (9, "same id, another text, and some words so that it is long enough to be judged at all, says the rule", "en"),
    (None, "a text without an id that has quite a number of words in it so that rules apply to its one line", "fr"),
    (None, None, None),
    (10, "Unique start of a line here.\n" + PASSAGE + "\nend of ten", "en"),
    (11, "Something else stands before. " + PASSAGE + " And after it too stands something else altogether.", "en"),
    (12, "é ß 漢字 😀 <|endoftext|> <s> ▁▁ a b c\x1cd  two   spaces \n x", "de"),
    (13, "line again and again and again, it says\n" * 6, "en"),
    (14, "x" * 5000, "en"),
    (15, "a" * 250, "en"),
]


def docs(spark, rows=ROWS):
    """``rows`` with columns whose names clash with those operators use themselves."""
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return out.withColumns({name: F.lit("clash") for name in ODD}).repartition(3)


def none(spark):
    return docs(spark, [])
