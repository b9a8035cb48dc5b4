"""Golden turns of chat templates, written from each model's public prompt format."""

import pytest

from siftwell.functions import templates as M

TURNS = [("user", "What is new"), ("assistant", "Not a lot"), ("user", "再见"), ("assistant", "Well")]

#: name: prompt of the first round (system "Be.", bos <s>, eos </s>), first reply, second prompt
GOLDEN = {
    "alpaca": ("Be.### Instruction:\nWhat is new\n\n### Response:\n", "Not a lot</s>\n\n", "### Instruction:\n再见\n\n### Response:\n"),
    "atom": ("Be.<s>Human: What is new\n</s><s>Assistant:", "Not a lot\n</s>", "<s>Human: 再见\n</s><s>Assistant:"),
    "baichuan": ("Be.<reserved_102>What is new<reserved_103>", "Not a lot", "<reserved_102>再见<reserved_103>"),
    "belle": ("<s>Be.Human: What is new\n\nBelle: ", "Not a lot</s>\n\n", "Human: 再见\n\nBelle: "),
    "breeze": ("<s>Be.[INST] What is new [/INST] ", "Not a lot", "[INST] 再见 [/INST] "),
    "chatglm2": ("[gMASK]sopBe.[Round 0]\n\n问：What is new\n\n答：", "Not a lot", "[Round 1]\n\n问：再见\n\n答："),
    "chatglm3": ("[gMASK]sop<|system|>\nBe.<|user|>\nWhat is new<|assistant|>", "\nNot a lot", "<|user|>\n再见<|assistant|>"),
    "cpm3": ("<s><|im_start|>system\nBe.<|im_end|>\n<|im_start|>user\nWhat is new<|im_end|>\n<|im_start|>assistant\n", "Not a lot<|im_end|>\n", "<|im_start|>user\n再见<|im_end|>\n<|im_start|>assistant\n"),
    "deepseek": ("<s>Be.\n\nUser: What is new\n\nAssistant:", "Not a lot</s>", "User: 再见\n\nAssistant:"),
    "deepseek3": ("<s>Be.<｜User｜>What is new<｜Assistant｜>", "Not a lot</s>", "<｜User｜>再见<｜Assistant｜>"),
    "default": ("System: Be.</s>\nHuman: What is new</s>\nAssistant:", "Not a lot</s>\n", "Human: 再见</s>\nAssistant:"),
    "empty": ("Be.What is new", "Not a lot", "再见"),
    "gemma": ("<s><start_of_turn>user\nBe.\n\nWhat is new<end_of_turn>\n<start_of_turn>model\n", "Not a lot<end_of_turn>\n", "<start_of_turn>user\n再见<end_of_turn>\n<start_of_turn>model\n"),
    "glm4": ("[gMASK]<sop><|system|>\nBe.<|user|>\nWhat is new<|assistant|>", "\nNot a lot", "<|user|>\n再见<|assistant|>"),
    "llama2": ("<s>[INST] <<SYS>>\nBe.\n<</SYS>>\n\nWhat is new [/INST]", "Not a lot</s>", "<s>[INST] 再见 [/INST]"),
    "llama3": (
        "<s><|start_header_id|>system<|end_header_id|>\n\nBe.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nWhat is new<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
        "Not a lot<|eot_id|>",
        "<|start_header_id|>user<|end_header_id|>\n\n再见<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    ),
    "mistral": ("<s>[INST] Be.\n\nWhat is new[/INST]", " Not a lot</s>", "[INST] 再见[/INST]"),
    "mistral_small": ("<s>[SYSTEM_PROMPT]Be.[/SYSTEM_PROMPT][INST]What is new[/INST]", "Not a lot</s>", "[INST]再见[/INST]"),
    "olmo": ("</s>Be.<|user|>\nWhat is new<|assistant|>\n", "Not a lot</s>", "<|user|>\n再见<|assistant|>\n"),
    "openchat": ("<s>Be.GPT4 Correct User: What is new</s>GPT4 Correct Assistant:", "Not a lot</s>", "GPT4 Correct User: 再见</s>GPT4 Correct Assistant:"),
    "orion": ("<s>Be.Human: What is new\n\nAssistant: </s>", "Not a lot</s>", "Human: 再见\n\nAssistant: </s>"),
    "phi4": ("<|im_start|>system<|im_sep|>Be.<|im_end|><|im_start|>user<|im_sep|>What is new<|im_end|><|im_start|>assistant<|im_sep|>", "Not a lot<|im_end|>", "<|im_start|>user<|im_sep|>再见<|im_end|><|im_start|>assistant<|im_sep|>"),
    "qwen": ("<|im_start|>system\nBe.<|im_end|>\n<|im_start|>user\nWhat is new<|im_end|>\n<|im_start|>assistant\n", "Not a lot<|im_end|>\n", "<|im_start|>user\n再见<|im_end|>\n<|im_start|>assistant\n"),
    "seed_coder": ("<s>system\nBe.</s><s>user\nWhat is new</s><s>assistant\n", "Not a lot</s>", "<s>user\n再见</s><s>assistant\n"),
    "yayi": ("<|System|>:\nBe.\n\n<|Human|>:\nWhat is new\n\n<|YaYi|>:", "Not a lot\n\n", "<|Human|>:\n再见\n\n<|YaYi|>:"),
    "yuan": ("Be.What is new<sep>", "Not a lot<eod>\n", "再见<sep>"),
    "zephyr": ("<|system|>\nBe.</s><|user|>\nWhat is new</s><|assistant|>\n", "Not a lot</s>", "<|user|>\n再见</s><|assistant|>\n"),
    "ziya": ("Be.<human>:What is new\n<bot>:", "Not a lot\n", "<human>:再见\n<bot>:"),
}


def test_golden_turns(spark):
    df = spark.createDataFrame([(TURNS,)], "m array<struct<role: string, content: string>>")
    got = df.select(*(M.render("m", M.resolve(n, system="Be."), end_token="</s>").alias(str(i)) for i, n in enumerate(GOLDEN))).first()
    for i, (name, want) in enumerate(GOLDEN.items()):
        assert tuple(got[i][:3]) == want, name


def test_calls_and_observations(spark):
    turns = [("user", "a"), ("function", "f()"), ("observation", "3"), ("assistant", "b")]
    df = spark.createDataFrame([(turns, "S", "T")], "m array<struct<role: string, content: string>>, s string, t string")
    got = df.select(*(M.render("m", M.resolve(n), "s", end_token="</s>", tools="t").alias(n) for n in ("mistral", "llama3", "granite4", "seed_oss", "ministral"))).first()
    assert got.mistral == ["<s>[INST] ST\n\na[/INST]", "[TOOL_CALLS] f()</s>", '[TOOL_RESULTS] {"content": 3}[/TOOL_RESULTS]', " b</s>"]
    assert got.llama3[1:3] == ["f()<|eot_id|>", "<|start_header_id|>ipython<|end_header_id|>\n\n3<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"]
    assert got.granite4[2] == "<|start_of_role|>tool<|end_of_role|>3<|end_of_text|>\n<|start_of_role|>assistant\n"
    assert got.seed_oss[1] == "<s>\nf()</s>" and got.ministral[2] == '[TOOL_RESULTS]{"content": 3}[/TOOL_RESULTS]'
    with pytest.raises(Exception, match="unknown role"):
        df.select(M.render("array(named_struct('role', 'robot', 'content', 'x'))", M.resolve("qwen"))).collect()


def test_thoughts(spark):
    t = M.resolve("qwen3")
    turns = [("user", "a"), ("assistant", "<think>\nx\n</think>\n\nb"), ("user", "c"), ("assistant", "d")]
    df = spark.createDataFrame([(turns,)], "m array<struct<role: string, content: string>>")
    df = df.withColumn("n", M.with_thoughts("m", t)).withColumn("r", M.render("n", t)).withColumn("w", M.render("m", t))
    row = df.select("n", M.prompt_and_response("r", "n", t).alias("yes"), M.prompt_and_response("r", "n", t, thinking=False).alias("no"), M.turn_pairs("w", "m", t).alias("all"), M.with_thoughts("m", t, thinking=False, whole=True).alias("bare")).first()
    assert row.n[1].content == "b" and row.bare[1].content == "b"
    assert row.yes.response == "<think>\n\n</think>\n\nd<|im_end|>\n" and row.no.response == "d<|im_end|>\n" and row.no.prompt.endswith("<|im_start|>assistant\n<think>\n\n</think>\n\n")
    assert [p.response for p in row["all"]] == ["<think>\nx\n</think>\n\nb<|im_end|>\n", "<think>\n\n</think>\n\nd<|im_end|>\n"]


def test_every_template_has_its_parts():
    assert len(M.TEMPLATES) == 121
    for name, t in M.TEMPLATES.items():
        assert "{{content}}" in t.user and "{{content}}" in t.reply and "{{content}}" in t.system and "{{content}}" in t.call, name
        assert not t.replace_eos or t.stop_words, name
    assert M.stop_words(M.resolve("qwen"), "<|endoftext|>") == ["<|im_end|>"] and M.stop_words(M.resolve("aquila"), "e") == ["e", "</s>"]


def test_jinja_texts():
    """By hand: two templates, one whose system text stands inside the first turn and one that numbers its rounds."""
    head = "{% set given = messages[0].role == 'system' %}{% set system = messages[0].content if given and messages[0].content else '' %}"
    loop = "{% for turn in (messages[1:] if given else messages) %}{% if turn.role == 'user' %}"
    assert M.jinja_text(M.TEMPLATES["llama2"], "</s>") == (
        head + r"{% set opening %}{% if system %}{{ '<<SYS>>\n' ~ system ~ '\n<</SYS>>\n\n' }}{% endif %}{% endset %}" + loop
        + "{{ '<s>' ~ '[INST] ' ~ ((opening if loop.first else '') ~ turn.content) ~ ' [/INST]' }}{% elif turn.role == 'assistant' %}{{ turn.content ~ '</s>' }}{% endif %}{% endfor %}"
    )
    assert M.jinja_text(M.TEMPLATES["chatglm2"]) == (
        head + "{{ '[gMASK]sop' }}{% if system %}{{ system }}{% endif %}" + loop
        + r"{{ '[Round ' ~ (loop.index0 // 2) ~ ']\n\n问：' ~ turn.content ~ '\n\n答：' }}{% elif turn.role == 'assistant' %}{{ turn.content }}{% endif %}{% endfor %}"
    )
    odd = M.Template(user="it's \\ {{content}}")
    assert r"{{ 'it\'s \\ ' ~ turn.content }}" in M.jinja_text(odd)
    assert all(M.jinja_text(t, "</s>").count("{%") == M.jinja_text(t, "</s>").count("%}") for t in M.TEMPLATES.values())
