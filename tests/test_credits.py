import base64
import re
import unicodedata

import pytest
from history import listen, library, listens, file, rows

from earshot.functions import constants as k
from earshot.functions.credits import with_artists
from earshot.operators.credits import artist_listens, credit_dimension, credit_dimension_rows, credited_rows, read_credits, refresh_credits
from earshot.operators import topstats
from history import CLOCK


def split(spark, credit, participants=None):
    df = spark.createDataFrame([(credit, participants)], "credit string, participants string")
    return [(a.name, a.id) for a in with_artists(df, "credit", "participants").first().artists]


def names(spark, credit, participants=None):
    return [n for n, _ in split(spark, credit, participants)]


def test_separators(spark):
    assert names(spark, "Anna, Ben") == ["Anna", "Ben"]
    assert names(spark, "Anna ft. Ben") == ["Anna", "Ben"]
    assert names(spark, "Anna FEAT Ben featuring Cid;Dee ; Eve") == ["Anna", "Ben", "Cid", "Dee", "Eve"]
    assert names(spark, "Anna/Ben") == ["Anna/Ben"]
    assert names(spark, "Anna & Ben") == ["Anna & Ben"]
    assert names(spark, "Anna,Ben") == ["Anna,Ben"]
    assert names(spark, "Leafeat Ben") == ["Leafeat Ben"]


@pytest.mark.parametrize("name", k.PROTECTED_CREDITS)
def test_protected_names_stay_whole(spark, name):
    assert names(spark, name) == [name]
    assert names(spark, "  " + name.upper().replace(" ", "  ")) == [name.upper()]


def test_same_name_in_other_case_is_one_artist_with_the_last_spelling(spark):
    assert names(spark, "Anna; Ben; ANNA") == ["ANNA", "Ben"]


def test_structured_names_win_when_there_are_several(spark):
    two = '{"artist":[{"name":"Tom, Dick"},{"name":"Harry"}]}'
    one = '{"artist":[{"name":"Other"}]}'
    assert names(spark, "X", two) == ["Tom, Dick", "Harry"]
    assert names(spark, "A, B", one) == ["A", "B"]
    assert names(spark, "A, B", "not json") == ["A", "B"]


def test_absent_and_empty_credits(spark):
    assert names(spark, None) == ["Unknown"]
    assert names(spark, "") == ["Unknown"]
    assert names(spark, ";") == []


def key(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip()).lower()


@pytest.mark.parametrize("name", ["Ｆｕｌｌ Ｗｉｄｔｈ", "Beyoncé", "ﬁne  print", "İstanbul", "Straße", "ΟΔΟΣ", "　x﻿"])
def test_unicode_names_and_ids(spark, name):
    [(shown, id)] = split(spark, name)
    expected = re.sub(r"[\s﻿]+", " ", unicodedata.normalize("NFKC", name)).strip()
    assert shown == expected
    encoded = base64.urlsafe_b64encode(expected.lower().encode()).decode().rstrip("=")
    assert id == "artist-" + encoded


def test_ids_of_long_names_have_no_line_breaks(spark):
    name = "long name " * 30
    [(shown, id)] = split(spark, name)
    assert id == "artist-" + base64.urlsafe_b64encode(key(name).encode()).decode().rstrip("=")


def test_collaborations_count_for_each_artist(spark):
    h = listens(
        spark, listen(1, artist="Anna, Ben"), listen(2, artist="Anna"), listen(3, artist=";"), listen(4, artist=None, artist_id="raw")
    )
    top = {r.artist_name: r.plays for r in topstats.top_artists(h, CLOCK).collect()}
    assert top == {"Anna": 2, "Ben": 1, None: 1}
    exploded = artist_listens(h)
    assert sorted((r.id, r.artist_name) for r in exploded.collect() if r.artist_name) == [(1, "Anna"), (1, "Ben"), (2, "Anna")]
    assert [r.artist_id for r in exploded.filter("artist_name is null").collect()] == ["raw"]


def test_membership_is_exact_whatever_the_number_of_credits(spark):
    h = listens(spark, listen(1, artist="Anna, Ben"), listen(2, artist="Annabel"), listen(3, artist="ANNA"))
    assert sorted(r.id for r in credited_rows(h, "anna").collect()) == [1, 3]


def test_library_tags_reach_the_history(spark):
    tags = '{"artist":[{"name":"Anna"},{"name":"Ben, the"}]}'
    lib = library(spark, file("1", artist="Anna & Ben", participants=tags), file("2", artist="Gone", missing=True))
    h = listens(spark, listen(1, artist="Anna & Ben"), listen(2, artist=None))
    dim = credit_dimension_rows(credit_dimension(h, lib)).drop("artist_id")
    assert sorted(rows(dim)) == [("Anna & Ben", 0, "Anna"), ("Anna & Ben", 1, "Ben, the"), ("Unknown", 0, "Unknown")]


def test_refresh_splits_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "credits")

    def dimension(h, files):
        return sorted(rows(credit_dimension(h, files)))

    h = listens(spark, listen(1, artist="A; B"), listen(2, artist="C"), listen(3, artist=None))
    files = library(spark, file("1", artist="A & D"))
    assert refresh_credits(spark, path, h, files) == 1
    assert sorted(rows(read_credits(spark, path))) == dimension(h, files)
    assert refresh_credits(spark, path, h, files) == 1  # nothing new, nothing written
    tag = '{"artist": [{"name": "A"}, {"name": "D"}]}'
    more = library(spark, file("1", artist="A & D"), file("2", artist="A & D", participants=tag), file("3", artist="E ft. F"))
    h = h.unionByName(listens(spark, listen(4, artist="G, H")))
    assert refresh_credits(spark, path, h, more) == 2
    assert sorted(rows(read_credits(spark, path))) == dimension(h, more)
    second = spark.read.parquet(f"{path}/generation=2")
    assert sorted(r.credit for r in second.collect()) == ["A & D", "E ft. F", "G, H"]
    assert refresh_credits(spark, path, h, files) == 3  # the tag is gone again
    kept = {r.credit: [a.name for a in r.artists] for r in read_credits(spark, path).collect()}
    assert kept["A & D"] == ["A & D"] and "E ft. F" in kept
    assert refresh_credits(spark, str(tmp_path / "none"), h.limit(0)) == 0
