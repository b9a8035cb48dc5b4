"""Chat templates inferred from rendered conversations.

Each conversation's text is cut at its turns' contents; what stands between two turns is the end of
one slot and the start of the next.  Over all conversations of a model these separators are counted by the two roles
that they stand between, the most frequent one counts, and the slots follow from them:

    user to assistant                 end of the user slot
    assistant to the end              end of the assistant slot
    assistant to user                 the same, and the start of the user slot
    start to user                     prefix (and default system text), and the start of the user slot
    start to system, system to user   prefix and the system slot

Counting is an aggregation, so a conversation is a row and a model any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a separator may name the round that it stands in.
ROUND = "{{idx}}"


def separators(df: DataFrame, model: str, messages: str, text: str) -> DataFrame:
    """model, before, after, separator, numbered, n: what stands between turns of two roles, and how often.

    messages: array<struct<role, content>>.  The text is searched from left to right; where it lacks a content, the row is left out.
    numbered: the separator with the round's number as {{idx}} (rounds are counted from 0, two turns each).
    """
    m = F.col(messages)

    def step(done: Column, turn: Column) -> Column:
        at = F.call_function("locate", turn["content"], F.col(text), done["at"])
        found = F.when(turn["content"] == "", done["at"]).otherwise(F.nullif(at, F.lit(0)))
        piece = F.substring(F.col(text), done["at"], found - done["at"])
        return F.struct((found + F.char_length(turn["content"])).cast("int").alias("at"), F.concat(done["parts"], F.array(piece)).alias("parts"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts"))
    walked = F.aggregate(m, start, step)
    rows = df.where(F.size(m) > 0).select(F.col(model).alias("model"), F.transform(m, lambda t: t["role"]).alias("roles"), F.col(text).alias("text"), walked.alias("walk")).where("walk.at IS NOT NULL")
    whole = F.concat(F.col("walk.parts"), F.array(F.substring(F.col("text"), F.col("walk.at"), F.char_length("text"))))
    offset = F.when(F.get("roles", F.lit(0)) == "system", 1).otherwise(0)
    cuts = rows.select("model", "roles", offset.alias("offset"), F.posexplode(whole).alias("i", "separator"))
    before = F.when(F.col("i") == 0, "start").otherwise(F.get("roles", F.col("i") - 1))
    after = F.when(F.col("i") == F.size("roles"), "end").otherwise(F.get("roles", F.col("i")))
    turn = F.col("i") - F.col("offset")
    number = F.floor(F.when(after == "end", turn - 1).otherwise(turn) / 2).cast("string")
    numbered = F.regexp_replace(F.col("separator"), F.concat(F.lit(r"(?<!\d)"), number, F.lit(r"(?!\d)")), F.lit(ROUND))
    return cuts.select("model", before.alias("before"), after.alias("after"), "separator", numbered.alias("numbered")).groupBy("model", "before", "after", "separator", "numbered").agg(F.count(F.lit(1)).alias("n"))


def _most(counts: DataFrame, name: str) -> DataFrame:
    """The most frequent value of a separator (ties: the smaller), and its share."""
    g = counts.groupBy("model", "before", "after", name).agg(F.sum("n").alias("n"))
    return g.groupBy("model", "before", "after").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(name).alias("value"))).alias("best"), F.sum("n").alias("all"))


def infer_templates(df: DataFrame, model: str, messages: str, text: str) -> DataFrame:
    """model, prefix, system, user, assistant, observation, function, default_system, system_in_first_user, agreement, unclear.

    Slots hold {{content}} (and {{idx}} where only the round's number differs).  agreement is the least share with which a
    separator was found; unclear names what the texts do not settle: ``user`` if a user turn after a reply and the
    first one start differently (its start is then taken from the later ones), ``system`` if what a system turn adds does not stand
    before the first user turn, ``default_system`` if conversations without a system turn start with more than those
    with one can explain, and each pair of roles that never met.
    """
    counts = separators(df, model, messages, text)
    plain, numbered = _most(counts, "separator"), _most(counts, "numbered")
    both = plain.alias("p").join(numbered.alias("q"), ["model", "before", "after"])
    better = F.col("q.best.less") < F.col("p.best.less")  # the number explains more
    picked = both.select("model", F.concat_ws(">", "before", "after").alias("pair"), F.col("p.best.value").alias("plain"), F.col("q.best.value").alias("numbered"), better.alias("better"), (-F.least("p.best.less", "q.best.less") / F.col("p.all")).alias("share"))
    # where later user turns are numbered, all of them are
    rounds = F.coalesce(F.max(F.when(F.col("pair") == "assistant>user", F.col("better"))).over(Window.partitionBy("model")), F.lit(False))
    picked = picked.withColumn("value", F.when(F.col("better") | (rounds & F.col("pair").endswith(">user")), F.col("numbered")).otherwise(F.col("plain")))
    by = picked.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("pair", "value"))).alias("s"), F.min("share").alias("agreement"))
    s = lambda pair: F.col("s")[pair]
    cut_head = lambda value, head: F.when(value.startswith(head), F.substring(value, F.char_length(head) + 1, F.char_length(value)))
    cut_tail = lambda value, tail: F.when(value.endswith(tail), F.substring(value, F.lit(1), F.char_length(value) - F.char_length(tail)))
    by = by.withColumn("reply_end", F.coalesce(cut_head(s("assistant>end"), F.lit("")), F.lit(""))).withColumn("ask_end", F.coalesce(s("user>assistant"), F.lit("")))
    by = by.withColumn("later", cut_head(s("assistant>user"), F.col("reply_end"))).withColumn("first", s("start>user"))
    # without a second round all that is known of the start is the first turn's
    by = by.withColumn("ask_start", F.coalesce("later", F.lit("")))
    by = by.withColumn("bare", F.coalesce(cut_tail(F.col("first"), F.col("ask_start")), F.col("first")))
    # a system text may stand inside the first user turn: then what comes before it holds that turn's start
    inside = s("system>user").isNotNull() & ~s("system>user").endswith(F.col("ask_start")) & s("start>system").contains(F.col("ask_start"))
    by = by.withColumn("inside", F.coalesce(inside, F.lit(False)))
    opening = F.substring(s("start>system"), F.lit(1), F.call_function("locate", F.col("ask_start"), s("start>system")) - 1)
    by = by.withColumn("opening", F.when(F.col("inside"), opening)).withColumn("sys_end", F.when(F.col("inside"), s("system>user")).otherwise(cut_tail(s("system>user"), F.col("ask_start"))))
    by = by.withColumn("sys_head", F.when(F.col("inside"), cut_head(s("start>system"), F.concat("opening", "ask_start"))).otherwise(s("start>system")))
    whole = F.concat("opening", "ask_start", "sys_head")  # what stands before a system text inside a turn
    own = F.when(F.col("first").startswith(whole) & F.col("first").endswith(F.col("sys_end")) & (F.char_length("first") > F.char_length(whole) + F.char_length("sys_end")), F.substring("first", F.char_length(whole) + 1, F.char_length("first") - F.char_length(whole) - F.char_length("sys_end")))
    # a prefix is what a system slot and a conversation without one share; what the latter has beyond it is a default
    lead = F.when(F.col("inside"), F.col("opening")).when(F.col("sys_head").isNull(), F.col("bare")).when(F.col("sys_head").startswith(F.col("bare")), F.col("bare"))
    by = by.withColumn("default_system", F.when(F.col("inside"), F.coalesce(own, F.lit(""))).when(lead.isNull() & F.col("bare").startswith(F.col("sys_head")) & F.col("bare").endswith(F.col("sys_end")), F.substring("bare", F.char_length("sys_head") + 1, F.char_length("bare") - F.char_length("sys_head") - F.char_length("sys_end"))).otherwise(F.lit("")))
    by = by.withColumn("prefix", F.coalesce(lead, F.when(F.col("default_system") != "", F.lit("")), F.lit("")))
    system = F.concat(F.coalesce(F.when(F.col("inside"), F.col("sys_head")).otherwise(cut_head(F.col("sys_head"), F.col("prefix"))), F.lit("")), F.lit("{{content}}"), F.coalesce("sys_end", F.lit("")))
    slot = lambda start, end: F.concat(start, F.lit("{{content}}"), end)
    inner = lambda role: F.when(s(f"{role}>assistant").isNotNull() & s(f"function>{role}").isNotNull(), slot(F.coalesce(cut_head(s(f"function>{role}"), F.col("call_end")), s(f"function>{role}")), s(f"{role}>assistant")))
    by = by.withColumn("call_end", F.coalesce(F.when(s("function>user").isNotNull(), cut_tail(s("function>user"), F.col("ask_start"))), F.col("reply_end")))
    missing = F.transform(F.filter(F.array(*(F.lit(p) for p in ("start>user", "user>assistant", "assistant>user", "assistant>end"))), lambda p: F.col("s")[p].isNull()), lambda p: p)
    odd_user = F.col("first").isNotNull() & F.col("later").isNotNull() & ~F.col("first").endswith(F.col("ask_start")) & (F.col("default_system") == "") | (s("assistant>user").isNotNull() & F.col("later").isNull())
    odd_system = s("system>user").isNotNull() & F.col("sys_end").isNull()
    odd_default = F.col("sys_head").isNotNull() & lead.isNull() & (F.col("default_system") == "")
    unclear = F.concat(missing, *(F.when(odd, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for name, odd in (("user", odd_user), ("system", odd_system), ("default_system", odd_default))))
    return by.select("model", "prefix", system.alias("system"), slot(F.col("ask_start"), F.col("ask_end")).alias("user"), slot(F.lit(""), F.col("reply_end")).alias("assistant"), inner("observation").alias("observation"), F.when(s("user>function").isNotNull(), slot(F.coalesce(cut_head(s("user>function"), F.col("ask_end")), F.lit("")), F.col("call_end"))).alias("function"), "default_system", F.col("inside").alias("system_in_first_user"), "agreement", unclear.alias("unclear"))


def fits(df: DataFrame, templates: DataFrame, model: str, messages: str, text: str) -> DataFrame:
    """df with fits: whether the model's inferred slots give the text again."""
    names = ("prefix", "system", "user", "assistant", "default_system", "system_in_first_user")
    t = templates.select(F.col("model").alias("_model"), *(F.col(c).alias(f"_{c}") for c in names))
    rows = df.join(t, F.col(model) == F.col("_model"), "left")
    m = F.col(messages)
    offset = F.when(F.get(m, F.lit(0))["role"] == "system", 1).otherwise(0)
    given = F.when(offset == 1, F.get(m, F.lit(0))["content"]).otherwise(F.col("_default_system"))
    own = F.when((given == "") & (offset == 0), "").otherwise(F.replace(F.col("_system"), F.lit("{{content}}"), given))
    inside = F.col("_system_in_first_user")
    content = lambda x, i: F.when(inside & (i == 0), F.concat(own, x["content"])).otherwise(x["content"])
    turn = lambda x, i: F.replace(F.replace(F.when(x["role"] == "assistant", F.col("_assistant")).otherwise(F.col("_user")), F.lit(ROUND), F.floor(i / 2).cast("string")), F.lit("{{content}}"), content(x, i))
    turns = F.transform(F.slice(m, offset + 1, F.greatest(F.size(m) - offset, F.lit(0))), turn)
    made = F.concat(F.col("_prefix"), F.when(inside, "").otherwise(own), F.array_join(turns, ""))
    return rows.withColumn("fits", F.coalesce(made == F.col(text), F.lit(False))).drop("_model", *(f"_{c}" for c in names))
