"""Rows that every operator of the training-data subpackage must cope with."""

LONG = "lorem ipsum dolor sit amet " * 6000

# (doc_id, text): nulls, empty, blank, short, repeated, long, non-ASCII and duplicate rows
EDGE = [
    (1, None), (2, ""), (3, " \t\n\r "), (4, "one"), (5, "two words"),
    (6, "a b c d e f a b c d e f g h i j k"), (7, LONG), (8, LONG + "x"),
    (9, "line one here\nline one here\n\nÜber größe ÉTÉ \u2003 wide \U0001F600 end"),
    (10, "same same same same same same same same same same same same"), (10, "same same same same same same same same same same same same"),
    (None, "a row without an id but with enough words to be read as prose"),
    (11, 'password = "hunter2-hunter2" AKIA' + "A1B2C3D4E5F6G7H8" + " deadbeefdeadbeefdeadbeef0 token=abc token: abcdefgh"),
]
SCHEMA = "doc_id long, text string"
# columns whose names the operators use themselves
CLASH = {"n": "1", "words": "'w'", "row": "2", "key": "'k'", "block": "3", "doc_key": "'x'", "gone_id": "doc_id",
         "bad_id": "doc_id", "kept": "false", "blob": "'b'", "score": "0.5", "grams": "'g'", "fail_bits": "7"}


def edge_docs(spark):
    return spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", *[f"{v} as {k}" for k, v in CLASH.items()])


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
