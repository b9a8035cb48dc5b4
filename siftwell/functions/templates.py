"""Rendering of conversations by chat templates, as column expressions.

``render`` gives one string per turn of a conversation; ``prompt_and_response`` and ``turn_pairs``
cut it for training, with the empty thoughts that reasoning templates ask for.  The templates
themselves are data in ``chat_formats``.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.chat_formats import TEMPLATES, Template

__all__ = ["TEMPLATES", "Template", "end_of", "jinja_text", "prompt_and_response", "register_template", "render", "resolve", "stop_words", "turn_pairs", "with_thoughts"]


def register_template(name: str, template: Template) -> None:
    if name in TEMPLATES:
        raise ValueError(f"template {name} is registered already")
    TEMPLATES[name] = template


def resolve(name: str, system: str | None = None, tool_format: str | None = None) -> Template:
    """A registered template with some parts overridden.  Another tool format brings a plain function slot."""
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name}; there are {sorted(TEMPLATES)}")
    t = TEMPLATES[name]
    t = replace(t, default_system=system) if system is not None else t
    return replace(t, tool_format=tool_format, function="{{content}}" if t.efficient_eos else "{{content}}{{eos}}") if tool_format is not None else t


def end_of(template: Template, end_token: str) -> str:
    """The end token that slots mean: the first stop word, if the template replaces the tokenizer's."""
    return template.stop_words[0] if template.replace_eos else end_token


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fill(slot: str, values: dict[str, str]) -> str:
    """A slot as a SQL concatenation: literal parts, and an expression for each placeholder."""
    parts = re.split(r"\{\{(\w+)\}\}", slot)
    items = [values[p] if i % 2 else _quoted(p) for i, p in enumerate(parts) if p]
    return f"concat({', '.join(items)})" if items else "''"


def render(messages: str, template: Template, system: str | None = None, end_token: str = "", begin_token: str = "<s>", tools: str | None = None) -> Column:
    """One string per turn of an array<struct<role, content>>; the first carries prefix and system text.

    system and tools are column names or expressions (a system text, a tool description); an empty
    or null system means the template's own.  Roles are user, assistant, observation and function
    (a call as the template's tool format writes it); any other role fails while running.
    """
    fixed = {"bos": _quoted(begin_token), "eos": _quoted(end_of(template, end_token)), "idx": "cast(floor(_at / 2) as string)"}
    slot = lambda s, content: _fill(s, {**fixed, "content": content})
    own = _quoted(template.default_system)
    text = f"if(coalesce({system}, '') = '', {own}, {system})" if system else own
    text = f"concat({text}, coalesce({tools}, ''))" if tools else text
    system_slot = f"if({text} = '', '', {slot(template.system, text)})"
    first = lambda x: f"if(_at = 0, {x}, '')"
    asked = f"concat({first(system_slot)}, _turn.content)" if template.system_in_first_user else "_turn.content"
    head = _fill(template.prefix, fixed) if template.system_in_first_user else f"concat({_fill(template.prefix, fixed)}, {system_slot})"
    roles = {"user": slot(template.user, asked), "assistant": slot(template.reply, "_turn.content"), "observation": slot(template.observation or template.user, "_turn.content"), "function": slot(template.call, "_turn.content")}
    cases = " ".join(f"when _turn.role = '{role}' then {made}" for role, made in roles.items())
    return F.expr(f"transform({messages}, (_turn, _at) -> concat({first(head)}, case {cases} else raise_error(concat('unknown role ', _turn.role)) end))")


def with_thoughts(messages: str, template: Template, thinking: bool | None = True, whole: bool = False) -> Column:
    """Messages as a reasoning template trains on them.

    Earlier replies lose their thoughts (whole: they keep them, as every reply is trained on);
    without thinking all replies do.
    """
    if not template.reasoning:
        return F.col(messages)
    pattern = _quoted(f"(?s)\\Q{template.thought[0]}\\E(.*?)\\Q{template.thought[1]}\\E")
    bare = f"regexp_replace(regexp_replace(_turn.content, {pattern}, ''), '^\\\\n+', '')"
    all_of_them, earlier = "_at % 2 = 1", f"_at % 2 = 1 and _at < size({messages}) - 2"
    when = all_of_them if thinking is False else None if whole else earlier
    if when is None:
        return F.col(messages)
    last = f" or (_at = size({messages}) - 1)" if thinking is False and not whole else ""
    return F.expr(f"transform({messages}, (_turn, _at) -> if({when}{last}, named_struct('role', _turn.role, 'content', {bare}), _turn))")


def _unthought(reply: str, template: Template) -> str:
    """Whether a reply's text holds neither thought word."""
    return " and ".join(f"not contains({reply}, {_quoted(w.strip())})" for w in template.thought)


def prompt_and_response(turns: str, messages: str | None = None, template: Template | None = None, thinking: bool | None = True) -> Column:
    """struct(prompt, response): everything but the last turn, and the last turn.

    With a reasoning template and its messages a reply without a thought gets an empty one: before
    the response, or without thinking at the prompt's end.
    """
    prompt, response = f"array_join(slice({turns}, 1, greatest(size({turns}) - 1, 0)), '')", f"coalesce(try_element_at({turns}, -1), '')"
    if template is not None and template.reasoning:
        empty = f"if({_unthought(f'element_at({messages}, -1).content', template)}, {_quoted(''.join(template.thought))}, '')"
        prompt, response = (f"concat({prompt}, {empty})", response) if not thinking else (prompt, f"concat({empty}, {response})")
    return F.expr(f"named_struct('prompt', {prompt}, 'response', {response})")


def turn_pairs(turns: str, messages: str | None = None, template: Template | None = None, thinking: bool | None = True) -> Column:
    """array of struct(prompt, response) for training on every reply, with empty thoughts as in prompt_and_response."""
    prompt, response = f"{turns}[2 * _k]", f"{turns}[2 * _k + 1]"
    if template is not None and template.reasoning:
        empty = f"if({_unthought(f'{messages}[2 * _k + 1].content', template)}, {_quoted(''.join(template.thought))}, '')"
        prompt, response = (f"concat({prompt}, {empty})", response) if not thinking else (prompt, f"concat({empty}, {response})")
    return F.expr(f"transform(filter(sequence(0, greatest(cast(size({turns}) / 2 as int) - 1, 0)), _k -> 2 * _k + 1 < size({turns})), _k -> named_struct('prompt', {prompt}, 'response', {response}))")


def stop_words(template: Template, end_token: str) -> list[str]:
    """The end token and the template's stop words, each once."""
    return list(dict.fromkeys([end_of(template, end_token), *template.stop_words]))


def jinja_text(template: Template, end_token: str = "", begin_token: str = "<s>") -> str:
    """The template as a Jinja text over ``messages``, for tokenizers that bring none.

    It writes system, user and assistant turns as ``render`` does; calls, observations and thoughts are left to the caller.
    """
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    values = {"bos": quoted(begin_token), "eos": quoted(end_of(template, end_token)), "idx": "(loop.index0 // 2)"}

    def shown(slot: str, content: str = "''") -> str:
        parts = re.split(r"\{\{(\w+)\}\}", slot)
        items = [(values | {"content": content})[p] if i % 2 else quoted(p) for i, p in enumerate(parts) if p]
        return "{{ " + " ~ ".join(items) + " }}" if items else ""

    asked = "((opening if loop.first else '') ~ turn.content)" if template.system_in_first_user else "turn.content"
    system = shown(template.system, "system")
    opening = "{% set opening %}{% if system %}" + system + "{% endif %}{% endset %}" if template.system_in_first_user else "{% if system %}" + system + "{% endif %}"
    return "".join(
        (
            "{% set given = messages[0].role == 'system' %}",
            "{% set system = messages[0].content if given and messages[0].content else " + quoted(template.default_system) + " %}",
            shown(template.prefix),
            opening,
            "{% for turn in (messages[1:] if given else messages) %}",
            "{% if turn.role == 'user' %}" + shown(template.user, asked) + "{% elif turn.role == 'assistant' %}" + shown(template.reply, "turn.content") + "{% endif %}",
            "{% endfor %}",
        )
    )
