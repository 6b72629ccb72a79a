"""CSV files with line breaks in quotes, cut into many splits."""

import csv
import random
import tempfile

import pytest

from casegate.operators.prepare import add_boundaries
from casegate.sources.files import read_csv
from casegate.sources.quoted import ends_open, read_quoted_csv

NOTES = ["plain", "a, b", "line\nbreak", 'say "x"', ",", ' "lead', '5" pipe', 'many\n\n"quotes",\n"and",commas,"\n', "", "ü" * 30, "w" * 400 + "\n" * 5]


@pytest.fixture
def split_size(spark):
    """Sets the size of splits; the session's own comes back afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def size(value):
        spark.conf.set(names[0], value)
        spark.conf.set(names[1], "1")

    yield size
    for name, value in before.items():
        spark.conf.set(name, value)


def written(rows, name="a.csv", folder=None, end="\n"):
    folder = folder or tempfile.mkdtemp(prefix="casegate-test-")
    with open(f"{folder}/{name}", "w", newline="") as out:
        csv.writer(out, lineterminator=end).writerows(rows)
    return folder


@pytest.mark.parametrize("size", ["128m", "5000", "300", "64"])
def test_splits_give_what_one_task_gives(spark, split_size, size):
    rng = random.Random(3)
    rows = [["id", "note", "x"]] + [[str(i), rng.choice(NOTES), rng.choice(["", "y", 'q"'])] for i in range(400)]
    folder = written(rows)
    whole = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/a.csv")
    wanted = sorted(map(tuple, whole.collect()), key=repr)
    split_size(size)
    found = read_quoted_csv(spark, f"{folder}/a.csv", "seq").collect()
    assert sorted((tuple(r)[:3] for r in found), key=repr) == wanted
    assert [r["id"] for r in sorted(found, key=lambda r: r["seq"])] == [str(i) for i in range(400)]
    assert len({r["seq"] for r in found}) == 400


def test_one_field_over_many_splits_and_files(spark, split_size):
    long = "\n".join('x,"y"' for _ in range(300))
    folder = written([["id", "note"], ["1", long], ["2", "b"]], end="\r\n")
    written([["id", "note"], ["3", "c\nd"]], "b.csv", folder)
    split_size("100")
    found = {r["id"]: (r["note"], r["seq"]) for r in read_quoted_csv(spark, folder, "seq").collect()}
    assert found["1"][0] == long and found["2"][0] == "b" and found["3"][0] == "c\nd"
    assert found["1"][1] < found["2"][1] < found["3"][1]


def test_open_fields_empty_files_and_headers(spark, split_size):
    folder = tempfile.mkdtemp(prefix="casegate-test-")
    with open(f"{folder}/open.csv", "w") as out:
        out.write('id,note\n1,a\n\n2,"never\nclosed\n')
    split_size("8")
    found = {r["id"]: r["note"] for r in read_quoted_csv(spark, f"{folder}/open.csv").collect()}
    assert found["1"] == "a" and set(found) == {"1", "2"} and "never\nclosed" in found["2"]
    with open(f"{folder}/none.csv", "w"):
        pass
    with pytest.raises(ValueError, match="no header"):
        read_quoted_csv(spark, f"{folder}/none.csv")
    with open(f"{folder}/head.csv", "w") as out:
        out.write("id,note\n")
    assert read_quoted_csv(spark, f"{folder}/head.csv").count() == 0
    with open(f"{folder}/names.csv", "w") as out:
        out.write("\ufeffid,,Note,note\n1,2,3,4\n")
    found = read_quoted_csv(spark, f"{folder}/names.csv")
    assert found.columns == ["id", "_c1", "Note2", "note3"] and tuple(found.first()) == ("1", "2", "3", "4")


def test_lines_end_inside_quotes_or_not():
    cases = {
        ("a,b", False): False, ('a,"b', False): True, ('"a""', False): True, ('"a"", b"', False): False, ('5" x,"y', False): True,
        ('5" x', False): False, ("c", True): True, ('c"', True): False, ('c"",d', True): True, ('c"x","d', True): True, ('c",5" d', True): False,
    }
    for (line, inside), wanted in cases.items():
        assert ends_open(line, inside) == wanted, line


def test_a_log_of_many_splits(spark, split_size):
    head = ["Case ID", "Activity", "Resource", "Start Timestamp", "Complete Timestamp", "Note"]
    day = "2022-02-17T{:02d}:00:00.000000"
    rows = [[str(i // 4), "ABCD"[i % 4], "Ann", day.format(8), day.format(9), "two\nlines"] for i in range(60)]
    folder = written([head, *rows])
    split_size("200")
    log = add_boundaries(read_csv(spark, f"{folder}/a.csv"))
    cases = {}
    for r in sorted(log.collect(), key=lambda r: (r["start_ts"], r["seq"])):
        cases.setdefault(r["case_id"], []).append(r["activity"])
    assert len(cases) == 15 and all(c == ["Start", "A", "B", "C", "D", "End"] for c in cases.values())
