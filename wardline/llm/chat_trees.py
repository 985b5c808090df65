"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees: each names its parent, and every path from a root to a leaf is a possible conversation. Iterative
self-joins double the reach of ancestor links, so a tree of depth d takes log2(d) joins; they give each leaf its root,
its depth and the score of its branch. Branches of a tree are ranked by score, then depth, then leaf, and the chosen
leaves walk back along the same links, longest first, which reaches all messages of their paths. Each path becomes one
text in a template that marks turns; control strings inside texts are escaped and the escape can be undone.

Defined results: null texts and roles are empty; a null conversation id is a conversation of its own; turns that tie
are ordered by role, then text, and repeated rows are turns as often as they stand; a message whose parent is missing
is a root; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.store import Store

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one into each ``<|``, so that no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a single backslash between ``<`` and ``|`` is the only one that isn't doubled."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _header(role: Column) -> Column:
    """Roles are on a line of their own: a line end becomes ``<\\~``, which ``escape`` never makes."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\~"))


def _role_back(header: Column) -> Column:
    return unescape(F.replace(header, F.lit("<\\~"), F.lit("\n")))


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each answers the one before it."""
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(w).cast("long")).withColumn("parent", F.when(F.col("message") > 1, F.col("message") - 1))
    return rows.select("tree", "message", "parent", "role", "text", F.lit(0.0).alias("score"))


def ancestors(messages: DataFrame, store: Store) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, message, root, depth, total score of its branch) and, for k = 0, 1, ..., the links 2**k steps up.

    A round joins the links with themselves and ends once no link is left, after log2 of the greatest depth. Links are
    written to the shared folder each round. Messages in a cycle of parents have no root and are left out.
    """
    real = messages.select(F.col("tree").alias("t"), F.col("message").alias("up"))
    first = messages.select("tree", "message", "score", F.col("parent").alias("p"))
    first = first.join(real, first["tree"].eqNullSafe(real["t"]) & (first["p"] == real["up"]), "left").select("tree", "message", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), "score")
    # up: the message 2**k steps up, null once the root is passed; depth and total count what has been passed.
    state = store.put(first.withColumn("total", F.col("score")).withColumn("root", F.when(F.col("up").isNull(), F.col("message"))).select("tree", "message", "up", "depth", "total", "root"), "links-0")
    steps, links, rounds = 1, [], messages.count()
    while not state.filter("up is not null").isEmpty():
        links.append(state.filter("up is not null").select("tree", "message", "up"))
        far = state.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"), F.col("root").alias("r2"))
        # Only messages that haven't met their root are joined.
        on = state.filter("up is not null")
        joined = on.join(far, on["tree"].eqNullSafe(far["t"]) & (on["up"] == far["m"]), "left")
        moved = joined.select("tree", "message", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("s2", F.lit(0.0))).alias("total"), F.coalesce("root", "r2").alias("root"))
        state = store.put(state.filter("up is null").unionByName(moved), f"links-{len(links)}")
        steps *= 2
        if steps > rounds:  # what is still open is a cycle
            break
    return state.filter("root is not null").select("tree", "message", "root", "depth", "total"), links


def choose_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, branch, place, role, text) of the ``best`` branches of each tree, branch 0 the highest-scored.

    A branch's score is the mean of its messages' scores.
    """
    store = Store(messages.sparkSession, "trees")
    messages = store.put(messages, "messages")
    reached, links = ancestors(messages, store)
    parents = messages.select(F.col("tree").alias("t"), F.col("parent").alias("m")).distinct()
    leaves = reached.join(parents, reached["tree"].eqNullSafe(parents["t"]) & (reached["message"] == parents["m"]), "left_anti")
    w = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "message")
    path = leaves.withColumn("branch", F.row_number().over(w) - 1).filter(F.col("branch") < best).select("tree", "branch", "message")
    for link in reversed(links):  # any distance up is a sum of different powers of two
        up = link.select(F.col("tree").alias("t"), F.col("message").alias("m"), "up")
        above = path.join(up, path["tree"].eqNullSafe(up["t"]) & (path["message"] == up["m"])).select("tree", "branch", F.col("up").alias("message"))
        path = store.put(path.unionByName(above), f"path-{store.n}")
    place = reached.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("depth").alias("place"))
    text = messages.select(F.col("tree").alias("t2"), F.col("message").alias("m2"), "role", "text")
    out = path.join(place, path["tree"].eqNullSafe(place["t"]) & (path["message"] == place["m"])).drop("t", "m")
    return out.join(text, out["tree"].eqNullSafe(text["t2"]) & (out["message"] == text["m2"])).select("tree", "branch", "place", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, branch, formatted, loss_spans): one text per path, and where assistant texts stand in it (start, length)."""
    head = F.concat(F.lit(START), _header(F.col("role")), F.lit("\n"))
    rows = paths.select(F.col("tree").alias("conv_id"), "branch", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(END), F.lit("\n")))
    w = Window.partitionBy("conv_id", "branch").orderBy("place")
    start = F.sum(F.length("turn")).over(w) - F.length("turn") + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct("place", start.alias("start"), F.length("body").alias("length")))
    turns = rows.withColumn("span", span).groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct("place", "turn"))).alias("x"), F.array_sort(F.collect_list("span")).alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].cast("long").alias("length")))
    return turns.select("conv_id", "branch", F.concat_ws("", F.transform("x", lambda t: t["turn"])).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, branch, turns, loss_text, formatted): the turns parsed from the text, and what the loss mask covers, unescaped."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))
    turns = F.transform(parts, lambda p: F.struct(
        _role_back(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END) - 1)).alias("text"),
    ))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return formatted.select("conv_id", "branch", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def format_conversations(turns: DataFrame) -> DataFrame:
    """The formatted texts of linear conversations (conv_id, turn, role, text)."""
    return format_paths(choose_paths(from_turns(turns)))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation the sums of what is read back from the output."""
    back = read_back(formatted)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
