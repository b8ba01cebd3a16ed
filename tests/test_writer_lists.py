"""Lists of writers are named without moving their text once per writer."""

import re

from royaltide.operators import search as S

from .conftest import rows


def make(spark):
    songs = spark.createDataFrame(
        [(1, "w1, w2", "a"), (2, "w2,w1", "b"), (3, "w9", "c"), (4, None, "d"), (5, "w1, w2", "e"), (5, "w1, w2", "e")],
        "song_id bigint, songwriters string, title string")
    writers = spark.createDataFrame([("w1", "Bo", "X"), ("w2", "Al", "Y")], "songwriter_id string, name string, pro_affiliation string")
    return songs, writers


def test_names_by_list(spark):
    got = rows(S.attach_writers(*make(spark)).select("song_id", "songwriters", "songwriter_names", "pro_affiliations"))
    assert got == [
        (1, "w1, w2", "Al, Bo", "X, Y"), (2, "w2,w1", "Al, Bo", "X, Y"), (3, "w9", "", ""),
        (5, "w1, w2", "Al, Al, Bo, Bo", "X, Y"),
    ]


def test_a_list_travels_as_a_digest(spark):
    tree = S.attach_writers(*make(spark))._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in tree.splitlines() if "Generate explode" in line and "songwriters#" in line]
    # The text is dropped where it is taken apart, and the digest of a row is all that goes with a writer.
    assert made and all(re.search(r", \[\d\], false", line) for line in made), made
