"""Record converters: raw training records to one canonical nested form.

Canonical columns: _prompt and _response (array of struct<role, content>), _system, _tools,
_images, _videos, _audios.  The v1 form has messages: array of struct<role, content: array of
struct<type, value>, loss_weight>.  A broken record keeps its row with empty arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<role: string, content: string>"
V1_MESSAGE = "struct<role: string, content: array<struct<type: string, value: string>>, loss_weight: double>"

#: Fixed role names of the common record layouts.
ROLE_TAGS = {"user": "human", "assistant": "gpt", "observation": "observation", "function": "function_call", "system": "system"}

CONVERTERS: dict[str, Callable[..., DataFrame]] = {}


def register_converter(name: str, fn: Callable[..., DataFrame]) -> None:
    if name in CONVERTERS:
        raise ValueError(f"converter {name} is registered already")
    CONVERTERS[name] = fn


def converter(name: str) -> Callable[..., DataFrame]:
    if name not in CONVERTERS:
        raise ValueError(f"unknown converter {name}; there are {sorted(CONVERTERS)}")
    return CONVERTERS[name]


def media(column: str | None, df: DataFrame, folder: str | None = None) -> Column:
    """Paths of one kind of media: null for none; relative paths under a folder if given."""
    if column is None or column not in df.columns:
        return F.lit(None).cast("array<string>")
    kind = dict(df.dtypes)[column]
    paths = F.col(column) if kind.startswith("array") else F.array(F.col(column))
    if folder is not None:
        paths = F.transform(paths, lambda p: F.when(p.rlike("^(/|[a-z0-9]+://)"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p)))
    return F.when(F.col(column).isNull() | (F.size(paths) == 0), None).otherwise(paths)


def _text(df: DataFrame, name: str | None) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name and name in df.columns else F.lit("")


def alpaca(df: DataFrame, key: str, prompt: str = "instruction", query: str | None = "input", response: str | None = "output", history: str | None = None, system: str | None = None, tools: str | None = None, kind: str = "sft", chosen: str = "chosen", rejected: str = "rejected", tag: str = "label", images: str | None = None, videos: str | None = None, audios: str | None = None) -> DataFrame:
    """Instruction records.  kind: sft, ranking (chosen and rejected) or feedback (a boolean tag)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    ask = F.concat_ws("\n", F.when(_text(df, prompt) != "", _text(df, prompt)), F.when(_text(df, query) != "", _text(df, query)))
    before = F.expr(f"flatten(transform(coalesce({history}, array()), h -> array(named_struct('role', 'user', 'content', h[0]), named_struct('role', 'assistant', 'content', h[1]))))") if history and history in df.columns else F.expr(f"cast(array() as array<{MESSAGE}>)")
    answer = _text(df, response)
    if kind == "feedback":
        responses = F.when(F.col(tag), F.array(turn("assistant", answer), turn("assistant", F.lit("")))).otherwise(F.array(turn("assistant", F.lit("")), turn("assistant", answer)))
    elif kind == "ranking":
        responses = F.array(turn("assistant", F.col(chosen)), turn("assistant", F.col(rejected)))
    else:
        responses = F.when(F.col(response).isNotNull(), F.array(turn("assistant", F.col(response)))).otherwise(F.expr(f"cast(array() as array<{MESSAGE}>)")) if response and response in df.columns else F.expr(f"cast(array() as array<{MESSAGE}>)")
    return df.select(key, F.concat(before, F.array(turn("user", ask))).cast(f"array<{MESSAGE}>").alias("_prompt"), responses.cast(f"array<{MESSAGE}>").alias("_response"), _text(df, system).alias("_system"), _text(df, tools).alias("_tools"), media(images, df).alias("_images"), media(videos, df).alias("_videos"), media(audios, df).alias("_audios"))


def _role_case(expr: str, tags: Mapping[str, str]) -> str:
    return "case " + " ".join(f"when {expr} = '{tag}' then '{role}'" for role, tag in tags.items()) + " end"


def sharegpt(df: DataFrame, key: str, messages: str = "conversations", role: str = "from", content: str = "value", tags: Mapping[str, str] = ROLE_TAGS, system: str | None = None, tools: str | None = None, chosen: str | None = None, rejected: str | None = None, tag: str | None = None, images: str | None = None, videos: str | None = None, audios: str | None = None) -> DataFrame:
    """Role-tagged message lists.

    A leading system message becomes _system.  Then even places must be human or observation, odd
    ones gpt or function_call, and the number of messages even (odd with chosen and rejected);
    anything else is broken.
    """
    t = dict(tags)
    rows = df.withColumn("_lead", F.expr(f"coalesce(try_element_at({messages}, 1).`{role}` = '{t['system']}', false)"))
    rows = rows.withColumn("_m", F.expr(f"case when {messages} is null or size({messages}) = 0 then array() when _lead then slice({messages}, 2, size({messages})) else {messages} end"))
    even, odd = f"x.`{role}` in ('{t['user']}', '{t['observation']}')", f"x.`{role}` in ('{t['assistant']}', '{t['function']}')"
    good = f"forall(transform(_m, (x, i) -> if(i % 2 = 0, {even}, {odd})), b -> coalesce(b, false))"
    ranked = chosen is not None
    good = f"size(_m) % 2 = {1 if ranked else 0} and size(_m) > 0 and {good}"
    if ranked:
        roles = f"('{t['assistant']}', '{t['function']}')"
        good += f" and {chosen}.`{role}` in {roles} and {rejected}.`{role}` in {roles}"
    canonical = f"transform(_m, x -> named_struct('role', {_role_case(f'x.`{role}`', t)}, 'content', x.`{content}`))"
    empty = f"cast(array() as array<{MESSAGE}>)"
    rows = rows.withColumn("_good", F.expr(f"coalesce({good}, false)")).withColumn("_c", F.expr(f"cast({canonical} as array<{MESSAGE}>)"))
    if ranked:
        pair = ", ".join(f"named_struct('role', {_role_case(f'{x}.`{role}`', t)}, 'content', {x}.`{content}`)" for x in (chosen, rejected))
        prompt, answer = "_c", f"array({pair})"
    elif tag:
        prompt = "slice(_c, 1, size(_c) - 1)"
        answer = f"if({tag}, array(element_at(_c, -1), named_struct('role', 'assistant', 'content', '')), array(named_struct('role', 'assistant', 'content', ''), element_at(_c, -1)))"
    else:
        prompt, answer = "slice(_c, 1, size(_c) - 1)", "slice(_c, size(_c), 1)"
    lead = F.expr(f"if(_lead, try_element_at({messages}, 1).`{content}`, null)")
    return rows.select(
        key,
        F.expr(f"if(_good, {prompt}, {empty})").cast(f"array<{MESSAGE}>").alias("_prompt"),
        F.expr(f"if(_good, {answer}, {empty})").cast(f"array<{MESSAGE}>").alias("_response"),
        F.coalesce(lead, _text(df, system)).alias("_system"),
        _text(df, tools).alias("_tools"),
        media(images, df).alias("_images"),
        media(videos, df).alias("_videos"),
        media(audios, df).alias("_audios"),
    )


def openai(df: DataFrame, key: str, messages: str = "messages", tools: str | None = None, separator: str = "\n</tool_response>\n<tool_response>\n", plain_system: str = "detailed thinking off") -> DataFrame:
    """Message lists whose assistant turns may call tools.

    tool_calls become JSON in a function turn; consecutive tool messages merge into one
    observation, and trailing ones are lost, as no later message flushes them.  The system text
    gets a note unless there are tools.
    """
    call = "if(x.tool_calls is not null and size(x.tool_calls) > 0, named_struct('role', 'function', 'content', to_json(transform(x.tool_calls, c -> c.function))), named_struct('role', x.role, 'content', x.content))"
    fold = f"""aggregate({messages}, named_struct('open', cast(null as string), 'out', cast(array() as array<{MESSAGE}>)), (a, x) -> if(x.role = 'tool',
      named_struct('open', if(a.open is null, x.content, concat(a.open, '{separator}', x.content)), 'out', a.out),
      named_struct('open', cast(null as string), 'out', concat(a.out, if(a.open is null, cast(array() as array<{MESSAGE}>), array(named_struct('role', 'observation', 'content', a.open))), array({call})))), a -> a.out)"""
    rows = df.withColumn("_all", F.expr(fold)).withColumn("_lead", F.expr("coalesce(try_element_at(_all, 1).role = 'system', false)"))
    rows = rows.withColumn("_c", F.expr("if(_lead, slice(_all, 2, size(_all)), _all)"))
    good = "size(_c) > 0 and size(_c) % 2 = 0 and forall(transform(_c, (x, i) -> if(i % 2 = 0, x.role in ('user', 'observation'), x.role in ('assistant', 'function'))), b -> coalesce(b, false))"
    empty = f"cast(array() as array<{MESSAGE}>)"
    base = F.when(F.col("_lead"), F.expr("try_element_at(_all, 1).content")).otherwise(F.lit(""))
    tool_text = _text(df, tools)
    system = F.when(tool_text != "", base).otherwise(F.concat_ws("\n", F.when(base != "", base), F.lit(plain_system)))
    return rows.withColumn("_good", F.expr(good)).select(key, F.expr(f"if(_good, slice(_c, 1, size(_c) - 1), {empty})").alias("_prompt"), F.expr(f"if(_good, slice(_c, size(_c), 1), {empty})").alias("_response"), system.alias("_system"), tool_text.alias("_tools"))


def alpaca_v1(df: DataFrame, key: str) -> DataFrame:
    """v1 messages; instruction and input are joined without a separator."""
    part = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("value")))
    message = lambda role, c, w: F.struct(F.lit(role).alias("role"), part(c).alias("content"), F.lit(float(w)).alias("loss_weight"))
    system = F.when(_text(df, "system") != "", F.array(message("system", _text(df, "system"), 0))).otherwise(F.expr(f"cast(array() as array<{V1_MESSAGE}>)"))
    ask = F.concat(_text(df, "instruction"), _text(df, "input"))
    user = F.when(ask != "", F.array(message("user", ask, 0))).otherwise(F.expr(f"cast(array() as array<{V1_MESSAGE}>)"))
    answer = F.when(_text(df, "output") != "", F.array(message("assistant", _text(df, "output"), 1))).otherwise(F.expr(f"cast(array() as array<{V1_MESSAGE}>)"))
    past = F.expr(f"cast(array() as array<{V1_MESSAGE}>)")
    if "history" in df.columns:
        past = F.expr("flatten(transform(filter(coalesce(history, array()), h -> size(h) = 2), h -> array(named_struct('role', 'user', 'content', array(named_struct('type', 'text', 'value', h[0])), 'loss_weight', 0D), named_struct('role', 'assistant', 'content', array(named_struct('type', 'text', 'value', h[1])), 'loss_weight', 1D))))")
    return df.select(key, F.concat(system, past, user, answer).alias("messages"))


def sharegpt_v1(df: DataFrame, key: str, messages: str = "conversations", role: str = "from", content: str = "value", tags: Mapping[str, str] = ROLE_TAGS) -> DataFrame:
    """v1 messages; any unknown tag empties the list, no parity is asked for."""
    t = dict(tags)
    known = ", ".join(f"'{x}'" for x in t.values())
    free = f"('{t['system']}', '{t['user']}', '{t['observation']}')"
    return df.select(
        key,
        F.expr(
            f"if(forall({messages}, x -> coalesce(x.`{role}` in ({known}), false)), transform({messages}, x -> named_struct('role', {_role_case(f'x.`{role}`', t)}, 'content', array(named_struct('type', 'text', 'value', x.`{content}`)), 'loss_weight', if(x.`{role}` in {free}, 0D, 1D))), cast(array() as array<{V1_MESSAGE}>))"
        ).alias("messages"),
    )


def pair_v1(df: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Two message lists; roles other than system, user and assistant are dropped."""
    one = "transform(filter({c}, x -> x.role in ('system', 'user', 'assistant')), x -> named_struct('role', x.role, 'content', array(named_struct('type', 'text', 'value', x.content)), 'loss_weight', if(x.role = 'assistant', 1D, 0D)))"
    return df.select(key, F.expr(one.format(c=chosen)).alias("chosen_messages"), F.expr(one.format(c=rejected)).alias("rejected_messages"))


for _name, _fn in (("alpaca", alpaca), ("sharegpt", sharegpt), ("openai", openai), ("alpaca_v1", alpaca_v1), ("sharegpt_v1", sharegpt_v1), ("pair_v1", pair_v1)):
    register_converter(_name, _fn)


# ---- validity -----------------------------------------------------------------------------


def valid_supervised(df: DataFrame) -> DataFrame:
    """An odd prompt and exactly one response."""
    return df.where((F.size("_prompt") % 2 == 1) & (F.size("_response") == 1))


def valid_pairwise(df: DataFrame) -> DataFrame:
    return df.where((F.size("_prompt") % 2 == 1) & (F.size("_response") >= 2))


def valid_unsupervised(df: DataFrame) -> DataFrame:
    return df.where(F.size("_prompt") % 2 == 1)


def placeholders_match(text: Column, paths: Column, placeholder: str = "<image>") -> Column:
    """As many placeholders in a text as there are media."""
    found = ((F.length(text) - F.length(F.replace(text, F.lit(placeholder), F.lit("")))) / len(placeholder)).cast("int")
    return found == F.coalesce(F.size(paths), F.lit(0))


def expand_placeholder(text: Column, placeholder: str, token: str, counts: Column) -> Column:
    """The i-th placeholder becomes counts[i] tokens."""
    parts = F.split(text, placeholder)
    before = F.concat(F.array(F.lit(0)), counts)  # nothing stands before the first part
    return F.array_join(F.zip_with(parts, before, lambda p, n: F.concat(F.repeat(F.lit(token), F.coalesce(n, F.lit(0))), F.coalesce(p, F.lit("")))), "")


def with_thought(content: Column, open_tag: str = "<think>\n", close_tag: str = "\n</think>\n\n") -> Column:
    return F.concat(F.lit(open_tag + close_tag), content)


def without_thought(content: Column, open_word: str = "<think>", close_word: str = "</think>") -> Column:
    """All thought blocks removed, and line breaks at the start."""
    return F.regexp_replace(F.regexp_replace(content, f"(?s){open_word}.*?{close_word}", ""), r"^\n+", "")


def few_shot(examples: DataFrame, support: DataFrame, key: str, subject: str) -> DataFrame:
    """messages of a question: every support example's question and answer, then the question itself.

    Both frames have question, A, B, C, D and answer; support also orders by ``shot`` and is small by definition.
    """
    ask = F.concat(F.col("question"), *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n{c}. "), F.col(c))).otherwise(F.lit("")) for c in "ABCD"), F.lit("\nAnswer:"))
    turns = support.select("shot", F.array(F.struct(F.lit("user").alias("role"), ask.alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("t"))
    shots = turns.groupBy().agg(F.expr("flatten(transform(array_sort(collect_list(struct(shot, t))), x -> x.t))").alias("_shots"))
    rows = examples.select(key, F.array(F.struct(F.lit("user").alias("role"), ask.alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("_own"))
    rows = rows.crossJoin(F.broadcast(shots)).withColumn("m", F.concat("_shots", "_own"))  # one row of shots
    head = f"The following are multiple choice questions (with answers) about {subject}.\n\n"
    return rows.select(key, F.expr("transform(m, (x, i) -> named_struct('role', x.role, 'content', if(i = 0, concat('" + head.replace("'", "\\'") + "', x.content), x.content)))").alias("messages"))
