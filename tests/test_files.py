import random

from pyspark.sql import functions as F

from sightline.functions import files as exprs
from sightline.operators.files import directory_sizes, file_rows


class Node:
    def __init__(self, size=0):
        self.children, self.size = {}, size

    def total(self):
        below = sum(c.total() for c in self.children.values())
        self.size = below if below > 0 else self.size
        return self.size


def model(rows):
    """Tree built file by file: path -> size."""
    root = Node()
    for path, length in rows:
        node = root
        for part in path[:-1]:
            node = node.children.setdefault(part, Node())
        node.children[path[-1]] = Node(length)
    root.total()
    out = {}

    def walk(node, prefix):
        for name, child in node.children.items():
            out["/".join([*prefix, name])] = child.size
            walk(child, [*prefix, name])

    walk(root, [])
    return out


def test_directory_sizes_against_a_tree(spark):
    rng = random.Random(2)
    lists = {}
    for n in range(60):
        lists[f"id{n}"] = [
            ([rng.choice("ab") for _ in range(rng.randint(1, 4))], rng.choice([0, 0, 1, 5, 9]))
            for _ in range(rng.randint(1, 9))
        ]
    rows = [(k, pos, path, size) for k, entries in lists.items() for pos, (path, size) in enumerate(entries)]
    df = spark.createDataFrame(rows, "k string, pos int, path array<string>, length long")
    got = {}
    for r in directory_sizes(df, "k").collect():
        got.setdefault(r.k, {})[r.path] = r["size"]
    assert got == {k: model(entries) for k, entries in lists.items()}


def test_unnamed_and_rows(spark):
    df = spark.createDataFrame(
        [("x", [(5, []), (7, ["d", "f"])])], "k string, files array<struct<length:long,path:array<string>>>"
    )
    got = {r.path: r["size"] for r in directory_sizes(file_rows(df, "k"), "k").collect()}
    assert got == {"<unnamed>": 5, "d": 7, "d/f": 7}


def test_shown_files_and_top_dirs(spark):
    kind = "files array<struct<length:long,path:array<string>>>, name string, size long, n int"
    df = spark.createDataFrame(
        [([(1, ["b", "x"]), (2, ["a"]), (3, ["b"])], "n", 6, 3), (None, "one", 4, 1), (None, None, 4, 1),
         (None, "none", 4, 2)], kind,
    )
    rows = df.select(
        exprs.shown_files(F.col("files"), F.col("name"), F.col("size"), F.col("n")).alias("s"),
        exprs.top_dirs(F.col("files")).alias("t"),
    ).collect()
    assert [len(r.s) for r in rows] == [3, 1, 1, 0]
    assert [r.t for r in rows] == [["a", "b"], None, None, None]
    assert rows[1].s[0].path == ["one"] and rows[2].s[0].path == ["(unnamed)"]
