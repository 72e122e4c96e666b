"""Tool-call linking: join calls and results by identifier, order calls, check arguments, print canonical JSON.

Calls are rows (conv_id, turn, call_id, name, arguments as JSON text, depends_on as identifiers); results are rows
(conv_id, call_id, content). Joins are on (conv_id, call_id), so one long conversation is spread over partitions,
and nothing gathers a conversation in one task.

Canonical JSON has its keys in ascending order, no spaces and numbers as parsed.

Defined results: a call without a result has none and isn't linked; of several results the least is taken;
arguments that are null or no JSON object fail the check; a dependency on no known call doesn't count; calls on
a cycle, or after one, have no level; calls without an identifier or conversation (null) link with nothing, have
no dependencies and level 0, and each of them gives its row; of repeated rows of one call the least is taken; other
columns are not read; empty tables give an empty result. Very long texts are printed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import count_words, stored, words_of

#: Tool name -> argument -> (type, required).
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "calculate": {"after": ("STRING", False), "limit": ("BIGINT", True)},
    "lookup": {"after": ("STRING", False), "limit": ("BIGINT", False), "query": ("STRING", True)},
    "search": {"after": ("STRING", False), "limit": ("BIGINT", True), "query": ("STRING", True)},
}
KEY = ["conv_id", "call_id"]


def one_of_each(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The least row of each key by ``columns``; rows with a null in the key all stay."""
    named = F.col(key[0]).isNotNull() & F.col(key[1]).isNotNull()
    least = rows.filter(named).groupBy(*key).agg(F.min(F.struct(*columns)).alias("m")).select(*key, "m.*")
    return least.union(rows.filter(~named).select(*key, *columns))


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``calls`` with ``result`` (null if there is none) and ``linked``."""
    one = results.groupBy(*KEY).agg(F.min("content").alias("result")).withColumn("linked", F.lit(True))
    return calls.join(one.hint("shuffle_hash"), KEY, "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies, else one more than the highest of them.

    Chains are contracted first: a dependency on a call that has only one itself becomes one on that, so many
    steps further back, and the steps double in every round. What is left hangs on calls without dependencies and on
    those with several. These are settled in rounds, each joining only the newest calls with the edges on them, so the
    rounds grow with the number of calls with several dependencies that follow each other, not with a chain's length.
    """
    nodes = calls.filter("call_id is not null").select(*KEY).distinct()
    edges = calls.select(*KEY, F.explode("depends_on").alias("dep")).distinct()
    known = nodes.select("conv_id", F.col("call_id").alias("dep"))
    edges = edges.join(known, ["conv_id", "dep"], "left_semi").withColumn("steps", F.lit(1).cast("long"))
    edges = contracted(stored(edges, "call-edges"))
    needs = stored(edges.groupBy(*KEY).agg(F.count("*").alias("needs")), "call-needs")
    newest = stored(nodes.join(needs, KEY, "left_anti").withColumn("level", F.lit(0).cast("long")), "call-levels")
    settled = newest
    while not newest.isEmpty():
        done = newest.select("conv_id", F.col("call_id").alias("dep"), "level")
        met = edges.join(done, ["conv_id", "dep"]).groupBy(*KEY).agg(
            F.count("*").alias("met"), F.max(F.col("level") + F.col("steps")).alias("level")
        ).withColumn("needs", F.lit(0).cast("long"))
        # what was met in earlier rounds has been taken from the needs and left its highest level there
        both = met.unionByName(needs.select(
            *KEY, F.lit(0).cast("long").alias("met"), (F.col("level") if "level" in needs.columns else F.lit(None).cast("long")).alias("level"), "needs",
        )).groupBy(*KEY).agg(F.sum("met").alias("met"), F.max("level").alias("level"), F.sum("needs").alias("needs"))
        needs = stored(both.select(*KEY, (F.col("needs") - F.col("met")).alias("needs"), "level"), "call-needs")
        newest = stored(needs.filter("needs = 0").select(*KEY, "level"), "call-levels")
        needs = needs.filter("needs > 0")
        settled = settled.union(newest)
    return settled


def contracted(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, dep, steps): edges past all calls that depend on one call only; the longest way counts.

    Edges that still end at such a call after as many doublings as calls allow run into a cycle; they stay and are
    never settled.
    """
    n, rounds = edges.count(), 0
    while 1 << rounds <= n:
        single = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("dep").alias("next"), F.min("steps").alias("more")).filter(
            "n = 1").select("conv_id", F.col("call_id").alias("dep"), "next", "more")
        further = edges.join(single, ["conv_id", "dep"], "left")
        longer = stored(further.groupBy(*KEY, F.coalesce("next", "dep").alias("dep")).agg(
            F.max(F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.max(F.col("next").isNotNull()).alias("moved")
        ), "call-edges")
        edges = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            break
        rounds += 1
    return edges


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with parsed arguments (a variant), in a fixed order; empty if nothing is."""
    kind = F.schema_of_variant(arguments)
    checks = []
    for tool, fields in sorted(schemas.items()):
        of_tool = name == tool
        for field, (type_, required) in sorted(fields.items()):
            found = F.schema_of_variant(F.variant_get(arguments, f"$.{field}", "variant"))
            checks.append(F.when(of_tool & found.isNull() & F.lit(required), F.lit(f"missing {field}")))
            checks.append(F.when(of_tool & found.isNotNull() & (found != type_), F.lit(f"type of {field}")))
        keys = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
        extra = F.size(F.array_except(keys, F.array(*map(F.lit, sorted(fields))))) > 0
        checks.append(F.when(of_tool & extra, F.lit("unknown argument")))
    of_known = F.coalesce(name.isin(*sorted(schemas)), F.lit(False))
    return F.when(arguments.isNull() | ~F.startswith(kind, F.lit("OBJECT")), F.array(F.lit("no object"))).when(
        ~of_known, F.array(F.lit("unknown tool"))
    ).otherwise(F.array_compact(F.array(*checks)))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row per call: conv_id, turn, call_id, name, level, linked, valid, errors and message (canonical JSON)."""
    one = one_of_each(calls, KEY, ["turn", "name", "arguments", "depends_on"])
    one = stored(one, "calls")
    linked = link_results(one, results).join(topological_levels(one), KEY, "left").withColumn(
        "level", F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), 0).otherwise(F.col("level"))
    ).withColumn("parsed", F.try_parse_json("arguments"))
    checked = linked.withColumn("errors", argument_errors(F.col("name"), F.col("parsed"), schemas))
    quoted = {c: F.coalesce(_json_string(F.col(c)), F.lit("null")) for c in ("call_id", "name", "result")}
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")),
        F.lit(',"call_id":'), quoted["call_id"],
        F.lit(',"errors":'), F.to_json("errors"),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), quoted["name"],
        F.lit(',"result":'), quoted["result"], F.lit("}"),
    )
    return checked.select(
        "conv_id", "turn", "call_id", "name", F.col("level").cast("long").alias("level"), "linked", (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", ",").alias("errors"), message.alias("message"),
    )


def _json_string(text: Column) -> Column:
    """A JSON string: the printed array of one text, without its brackets."""
    printed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), printed.substr(F.lit(2), F.length(printed) - 2))


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of conversations: each assistant turn calls a tool on the user's words before it.

    The user's next turn is the result. Neighbouring turns meet by a join on (conv_id, turn). Of rows with the
    same conversation and turn, the least by role and text is taken; rows with a null in either are turns of their own.
    """
    one = stored(one_of_each(turns, ["conv_id", "turn"], ["role", "text"]), "turns")
    asked = one.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.array_join(words_of(F.col("text")), " ").alias("query"),
        count_words(F.col("text")).alias("n"),
    )
    calls = one.filter("role = 'assistant'").select("conv_id", "turn", F.length("text").alias("size")).join(
        asked, ["conv_id", "turn"], "left"
    )
    identifier = F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    earlier = F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 2).cast("string"))
    after = F.when((F.col("turn") > 1) & (F.col("n") % 2 == 0), earlier)
    as_text = F.concat(F.lit('"limit":"'), F.col("n").cast("string"), F.lit('",'))
    as_number = F.concat(F.lit('"limit":'), F.col("n").cast("string"), F.lit(","))
    arguments = F.concat(
        F.lit("{"), F.coalesce(F.when(F.col("n") % 11 == 0, as_text).otherwise(as_number), F.lit("")),
        F.coalesce(F.concat(F.lit('"query":'), _json_string(F.when(F.col("query") != "", F.col("query"))), F.lit(", ")), F.lit("")),
        F.lit('"after":'), F.coalesce(_json_string(after), F.lit('""')), F.lit("}"),
    )
    names = F.array(*map(F.lit, ["search", "lookup", "calculate", "translate"]))
    calls = calls.select(
        "conv_id", "turn", identifier.alias("call_id"),
        F.get(names, F.when(F.col("size") % 13 == 0, 3).otherwise(F.col("size") % 3)).alias("name"),
        arguments.alias("arguments"), F.array_compact(F.array(after)).alias("depends_on"),
    )
    results = one.filter("role = 'user' and turn > 0").select(
        "conv_id", F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("text").alias("content"),
    )
    return calls, results
