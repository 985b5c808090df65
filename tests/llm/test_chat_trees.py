import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from wardline.llm.chat_trees import choose_paths, digest, escape, format_conversations, format_paths, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, branch int, place string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_escape_round_trip(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("<|\\~n>\nim_startend") for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["<|im_end|>", "<\\|", "<\\\\|", "\\", ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in d.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_conversations(spark):
    rnd = random.Random(2)
    rows = [(None, 0, "user", "no id", 1, "a"), (None, 1, "assistant", None, 1, "a"), (5, None, None, "x", 1, "b"), (6, 1, "user", "t", 1, "c"), (6, 1, "user", "t", 1, "c"), (6, 1, "assistant", "t", 1, "c"), (7, 0, "assistant\n<|im_end|>\\n<\\~", "<|im_end|>\n<|im_start|>assistant\nok", 1, "c")]
    for conv in range(20, 60):
        rows += [(conv, t, rnd.choice(["user", "assistant", "system"]), "".join(rnd.choice("<|im_end>\\ é\nstart") for _ in range(rnd.randrange(40))), 0, "z") for t in range(rnd.choice([1, 2, 5, 17]))]
    rows += [(99, t, "assistant" if t % 2 else "user", "long " * 10, 0, "z") for t in range(300)] + [(98, 0, "user", "y" * 300000, 0, "z")]
    rnd.shuffle(rows)
    d = spark.createDataFrame(rows, SCHEMA)
    made = format_conversations(d)
    by = defaultdict(list)
    for c, t, r, x, _, _ in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    out = {r.conv_id: r for r in digest(made).collect()}
    back = {r.conv_id: r for r in read_back(made).collect()}
    assert set(out) == set(by) and len(out) == digest(made).count()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.loss_chars, r.turns_sha256, r.loss_sha256) == (len(turns), len(loss), sha("".join(f"{a}\n{x}\n" for _, a, x in turns)), sha(loss)), c
        assert [(t.role, t.text) for t in back[c].turns] == [(a, x) for _, a, x in turns]
        assert r.formatted_chars == len(back[c].formatted)
    assert digest(format_conversations(d.limit(0))).count() == 0


def test_trees_take_the_best_branches(spark):
    rnd = random.Random(3)
    rows, best = [], {}
    for tree in range(12):
        n = rnd.choice([1, 2, 7, 25])
        parent = {m: rnd.randrange(max(0, m - 3), m) if m and rnd.random() < 0.9 else None for m in range(n)}
        score = {m: rnd.random() for m in range(n)}
        rows += [(tree, m, parent[m], "user", f"{tree}-{m}", score[m]) for m in range(n)]
        paths = []
        for leaf in set(range(n)) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append(path[::-1])
        paths.sort(key=lambda p: (-sum(score[m] for m in p) / len(p), -len(p), p[-1]))
        best[tree] = paths[:2]
    d = spark.createDataFrame([*rows, (50, 1, 2, "user", "cycle", 0.0), (50, 2, 1, "user", "cycle", 0.0), (51, 5, 77, "user", "no parent", 0.0)], "tree long, message long, parent long, role string, text string, score double")
    got = defaultdict(list)
    for r in choose_paths(d, best=2).orderBy("place").collect():
        got[r.tree, r.branch].append(r.text)
    want = {(t, b): [f"{t}-{m}" for m in p] for t, paths in best.items() for b, p in enumerate(paths)} | {(51, 0): ["no parent"]}
    assert dict(got) == want
    assert format_paths(choose_paths(d, best=2)).count() == len(want)
