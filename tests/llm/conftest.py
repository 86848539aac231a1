import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 6_000 + "x" * 3_000 + " 4111 1111 1111 1111 " + "ß" * 1_500
COMMON = "the same long passage of words stands in more than one document here, word for word, and it is over fifty bytes"

#: (doc_id, text): null and empty texts, blanks, repeats, ties, non-ASCII, long runs, near copies, repeated rows, a null id.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n \x0b"),
    (4, "one"),
    (5, "Mail a.b@c.example.org or +1 (555) 010-9999, ip 10.0.0.1 and 999.1.1.1; card 4111-1111-1111-1111."),
    (6, COMMON),
    (7, f"start {COMMON} end"),
    (8, f"start {COMMON} end"),
    (9, "naïve façade 東京タワー 🙂🙂 zero​width  nbsp"),
    (10, "same line\nsame line\n\nsame line\n"),
    (11, LONG),
    (12, "a b c " * 40),
    (12, "a b c " * 40),
    (13, "word " * 30 + "other"),
    (14, "word " * 30 + "else"),
    (15, "1.2.3.4.5.6.7.8 a@b.c._x@y.z " + "9" * 400 + " +1 2"),
    (None, "a document without an id, long enough to have several shingles and its own passage of bytes"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 3}" if d != 4 else None, len(t or "")) for d, t in EDGE], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {c: F.lit(7) for c in ("rank", "score", "h", "k", "n", "count", "kept", "label", "word", "slot", "shard", "rate", "base", "all", "sid", "grade", "chunk")}
    return rows.withColumns(extra).persist()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
