"""Tool-call linking: calls and results joined by identifier, put in topological order, checked and serialised.

Calls: conv_id, call_id, turn, name, arguments (JSON text), after (ids of calls that this one needs).
Results: conv_id, call_id, turn, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.llm.shared import save

#: Parameters of the tools: type, whether it is required, and the least length of a string or least value of a number.
SCHEMAS = {"ask": {"text": ("string", True, 1), "turn": ("integer", True, 0)}}
#: Variant types that satisfy a schema type.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
#: Rounds in which orders are passed on before conversations that aren't settled are ordered one by one.
ROUNDS = 24
#: Turns in a range of the two-level ranking.
RANGE = 256


def argument_errors(name: Column, args: Column, schemas=SCHEMAS) -> Column:
    """Sorted array of what is wrong with the arguments (a variant; null if the text is no JSON)."""
    known = F.lit(False)
    checks = F.array().cast("array<string>")
    for tool, parameters in schemas.items():
        found = []
        for p, (kind, required, least) in parameters.items():
            value = F.try_variant_get(args, f"$.{p}", "variant")
            there = F.schema_of_variant(value)
            missing = value.isNull() | (there == "VOID")
            if required:
                found.append(F.when(missing, F.lit(f"missing {p}")))
            fits = F.lit(False)
            for t in TYPES[kind]:
                fits = fits | there.startswith(t)
            found.append(F.when(~missing & ~fits, F.lit(f"type {p}")))
            if least is not None:
                amount = F.length(F.try_variant_get(args, f"$.{p}", "string")) if kind == "string" else F.try_variant_get(args, f"$.{p}", "double")
                found.append(F.when(~missing & fits & (amount < least), F.lit(f"range {p}")))
        keys = F.map_keys(F.coalesce(F.from_json(F.to_json(args), "map<string,string>"), F.create_map().cast("map<string,string>")))
        other = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in parameters])), lambda k: F.concat(F.lit("unknown "), k))
        checks = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), other)).otherwise(checks)
        known = known | (name == tool)
    no_object = args.isNull() | ~F.schema_of_variant(args).startswith("OBJECT")
    return F.when(~F.coalesce(known, F.lit(False)), F.array(F.lit("unknown tool"))).when(no_object, F.array(F.lit("not an object"))).otherwise(F.array_sort(checks))


def _one_by_one(pdf):
    """Keys and ties of one conversation's calls by the rule of `topological_keys`, each after those it needs; calls on or behind a cycle come last, by turn."""
    import pandas as pd

    turns = pdf.drop_duplicates("call_id").set_index("call_id")["turn"].to_dict()
    needs: dict = {i: set() for i in turns}
    for i, p in zip(pdf["call_id"], pdf["pred"]):
        if p is not None and p in turns:
            needs[i].add(p)
    after: dict = {i: [] for i in turns}
    for i, ps in needs.items():
        for p in ps:
            after[p].append(i)
    open_ = {i: len(ps) for i, ps in needs.items()}
    at: dict = {}
    ready = [i for i in turns if not open_[i]]
    while ready:
        i = ready.pop()
        at[i] = max([(turns[i], 0), *[(at[p][0], at[p][1] + 1) for p in needs[i]]])
        for j in after[i]:
            open_[j] -= 1
            if not open_[j]:
                ready.append(j)
    end = max([*turns.values(), *[k for k, _ in at.values()]]) + 1
    rest = sorted((i for i in turns if i not in at), key=lambda i: (turns[i], i))
    rows = [(i, k, tie, False) for i, (k, tie) in at.items()] + [(i, end, n, True) for n, i in enumerate(rest)]
    return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], **{c: [r[k] for r in rows] for k, c in enumerate(("call_id", "key", "tie", "cyclic"))}})


def topological_keys(calls: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(conv_id, call_id, key, tie, cyclic): calls sorted by (key, tie, ..) come after those they need.

    The key begins as the turn, which is an order already wherever calls need earlier ones. A call that
    needs one of no lesser (key, tie) takes that key and the next tie, round by round, so the number of
    rounds is that of such steps in a row and not the length of a conversation. Conversations that
    haven't settled after `rounds`, such as those with cycles, get their keys by the same rule one by one, a
    task holding one conversation's identifiers and turns.
    """
    nodes = calls.groupBy("conv_id", "call_id").agg(F.min("turn").cast("long").alias("key")).withColumn("tie", F.lit(0).cast("long"))
    edges = calls.select("conv_id", "call_id", F.explode_outer("after").alias("pred")).where("pred is not null").distinct()
    edges = edges.join(nodes.select(F.col("conv_id").alias("c_"), F.col("call_id").alias("i_")), (F.col("conv_id") == F.col("c_")) & (F.col("pred") == F.col("i_")), "left_semi")
    nodes, edges = save(nodes, "nodes"), save(edges, "edges")
    place = lambda n, a: n.select(F.col("conv_id").alias(f"{a}c"), F.col("call_id").alias(f"{a}i"), F.struct("key", "tie").alias(f"{a}at"))

    def late(nodes):
        e = edges.join(place(nodes, "p"), (F.col("conv_id") == F.col("pc")) & (F.col("pred") == F.col("pi"))).join(place(nodes, "v"), (F.col("conv_id") == F.col("vc")) & (F.col("call_id") == F.col("vi")))
        return e.where("pat >= vat").groupBy("conv_id", "call_id").agg(F.max(F.struct(F.col("pat.key").alias("key"), (F.col("pat.tie") + 1).alias("tie"))).alias("to"))

    moved = save(late(nodes), "late")
    for _ in range(rounds):
        if moved.isEmpty():
            return nodes.withColumn("cyclic", F.lit(False))
        to = moved.select(F.col("conv_id").alias("c_"), F.col("call_id").alias("i_"), "to")
        at = F.greatest(F.struct("key", "tie"), F.coalesce("to", F.struct("key", "tie")))
        nodes = save(nodes.join(to, (F.col("conv_id") == F.col("c_")) & (F.col("call_id") == F.col("i_")), "left").select("conv_id", "call_id", at["key"].alias("key"), at["tie"].alias("tie")), "nodes")
        moved = save(late(nodes), "late")
    open_ = moved.select(F.col("conv_id").alias("c_")).distinct()
    slim = calls.groupBy("conv_id", "call_id").agg(F.min("turn").cast("long").alias("turn")).join(open_, F.col("conv_id") == F.col("c_"), "left_semi")
    slim = slim.join(edges.withColumnsRenamed({"conv_id": "c_", "call_id": "i_"}), (F.col("conv_id") == F.col("c_")) & (F.col("call_id") == F.col("i_")), "left").select("conv_id", "call_id", "turn", "pred")
    exact = slim.groupBy("conv_id").applyInPandas(_one_by_one, f"conv_id {dict(calls.dtypes)['conv_id']}, call_id string, key long, tie long, cyclic boolean")
    return nodes.join(open_, F.col("conv_id") == F.col("c_"), "left_anti").withColumn("cyclic", F.lit(False)).unionByName(exact)


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per row of calls with conv_id and call_id: conv_id, call_id, turn, name, result_turn, n_results, order_no, cyclic, valid, errors, json.

    A call's result is that of its identifier with the least turn (then content); n_results counts all.
    order_no: place in the conversation's topological order, from 0; calls of one identifier have one
    place. errors: sorted, comma-joined. json: keys in code-point order, no white space, the arguments
    null where they are no JSON. Calls or results without conv_id or call_id can't be linked and are left
    out; null turns count as 0.
    """
    calls = calls.where("conv_id is not null and call_id is not null").withColumn("turn", F.coalesce("turn", F.lit(0)))
    results = results.where("conv_id is not null and call_id is not null")
    keys = topological_keys(calls.select("conv_id", "call_id", "turn", "after"))
    keys = keys.withColumn("range", F.floor(F.col("key") / RANGE))
    per_range = keys.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = per_range.select(F.col("conv_id").alias("c_"), F.col("range").alias("r_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv_id", "range").orderBy("key", "tie", "call_id")
    order = keys.withColumn("nth", F.row_number().over(within) - 1).join(base, (F.col("conv_id") == F.col("c_")) & (F.col("range") == F.col("r_")))
    order = order.select(F.col("conv_id").alias("oc"), F.col("call_id").alias("oi"), (F.col("base") + F.col("nth")).cast("long").alias("order_no"), "cyclic")
    first = results.groupBy(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri")).agg(F.min(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "content")).alias("result"), F.count("*").alias("n_results"))
    d = calls.join(first, (F.col("conv_id") == F.col("rc")) & (F.col("call_id") == F.col("ri")), "left").join(order, (F.col("conv_id") == F.col("oc")) & (F.col("call_id") == F.col("oi")))
    d = d.withColumn("args", F.try_parse_json("arguments"))
    d = d.withColumn("errors", argument_errors(F.col("name"), F.col("args"), schemas))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null"))
    quoted_or_null = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("args"), F.lit("null")), F.lit(',"call_id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted_or_null(F.col("name")),
        F.lit(',"result":'), quoted_or_null(F.col("result.content")), F.lit("}"),
    )
    return d.select(
        "conv_id", "call_id", "turn", "name", F.col("result.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "order_no", "cyclic",
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"), json.alias("json"),
    )


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a table of plain turns (conv_id, turn, role, text) stands for.

    A user's turn t calls the tool "ask" under the identifier c<t> and needs the call c<t-2>, whose answer
    it has seen, if there is one; an assistant's turn t is the result of c<t-1>. Other roles are neither.
    """
    ident = lambda t: F.concat(F.lit("c"), t.cast("string"))
    turn = F.col("turn")
    calls = conversations.where("role = 'user'").select(
        "conv_id", ident(turn).alias("call_id"), "turn", F.lit("ask").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.array(ident(turn - 2)).alias("after")
    )
    results = conversations.where("role = 'assistant'").select("conv_id", ident(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
