import random

from pyspark.sql import functions as F

from veilspark.llm import chat_trees as ct

SCHEMA = "tree long, node long, parent long, role string, text string, score double, extra string"


def brute(rows, top_k):
    out = {}
    by_tree = {}
    for r in rows:
        by_tree.setdefault(r[0], {})[r[1]] = r
    for tree, nodes in by_tree.items():
        parents = {r[2] for r in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][2]
            if at in nodes:
                continue
            scores = [nodes[x][5] or 0 for x in path]
            paths.append((-sum(scores) / len(scores), leaf, path[::-1]))
        for k, (_, _, path) in enumerate(sorted(paths)[:top_k]):
            out[(tree, k + 1)] = [(nodes[x][3] or "", nodes[x][4] or "") for x in path]
    return out


def test_best_branches_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for tree in [*range(8), None]:
        for node in range(rng.randint(1, 30)):
            rows.append((tree, node, rng.randrange(node) if node else None, rng.choice(["user", "assistant", None, "a\nb%0A"]), rng.choice(["hi", "", None, "<|im_end|>", "<\\|x<|", "é|<"]), rng.choice([None, 1.0, 2.0, 3.5]), "x"))
    rows += [(90, 1, 2, "user", "loop", 1.0, ""), (90, 2, 1, "user", "loop", 1.0, ""), (91, 5, 77, "user", "orphan", 1.0, "")]
    rows += [(92, i, i - 1 if i else None, "user", str(i), 0.0, "") for i in range(70)]
    done = ct.format_trees(spark.createDataFrame(rows, SCHEMA), top_k=2)
    read = done.select("tree", "branch", "n_turns", ct.read_turns(F.col("formatted")).alias("turns"), ct.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {(r.tree, r.branch): [(t.role, t.text) for t in r.turns] for r in read}
    assert got == brute(rows, 2)
    for r in read:
        assert r.loss == [t.text for t in r.turns if t.role == "assistant"]
        assert r.n_turns == len(r.turns)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 1, None, "user", "b", 0.0, ""), (1, 1, None, "user", "a", 0.0, ""), (1, None, None, "user", "no number", 0.0, "")]
    done = ct.format_trees(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.tree, r.formatted) for r in done] == [(1, "<|im_start|>user\na<|im_end|>\n")]
    assert ct.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0


def test_threads_of_plain_rows_with_ties(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 1, "assistant", "b"), (None, None, None, None)]
    done = ct.format_trees(ct.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in done.select("tree", ct.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("assistant", "c")], None: [("", "")]}
