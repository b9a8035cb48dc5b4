"""Public prompt formats of chat models, as data.

Fixed values: slots, tokens, system texts, stop words and thought words are what the models
expect.  {{content}} is a turn's text, {{idx}} its round; {{bos}} and {{eos}} are the tokenizer's
own tokens.  A template without an assistant slot ends replies with the end token, unless its
end is part of the next turn (efficient_eos).
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Template:
    user: str = "{{content}}"
    assistant: str | None = None
    system: str = "{{content}}"
    function: str | None = None
    observation: str | None = None
    prefix: str = ""
    default_system: str = ""
    stop_words: tuple[str, ...] = ()
    thought: tuple[str, str] = ("<think>\n", "\n</think>\n\n")
    tool_format: str = "default"
    system_in_first_user: bool = False
    efficient_eos: bool = False
    replace_eos: bool = False
    reasoning: bool = False  # replies without a thought get an empty one, earlier thoughts go
    media: str = "base"

    @property
    def reply(self) -> str:
        return self.assistant if self.assistant is not None else "{{content}}" if self.efficient_eos else "{{content}}{{eos}}"

    @property
    def call(self) -> str:
        return self.function if self.function is not None else self.reply


CURIOUS = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
HELPFUL = "You are a helpful assistant."
INTERNLM = (
    "You are an AI assistant whose name is InternLM (书生·浦语).\n"
    "- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n"
    "- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."
)

# families that several models share
_CHATML = Template(
    user="<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n",
    assistant="{{content}}<|im_end|>\n",
    system="<|im_start|>system\n{{content}}<|im_end|>\n",
    stop_words=("<|im_end|>",),
)
_CHATML_TOOL = replace(_CHATML, observation="<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n")
_QWEN = replace(
    _CHATML,
    function="{{content}}<|im_end|>\n",
    observation="<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n",
    tool_format="qwen",
    replace_eos=True,
)
_GEMMA = Template(
    user="<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n",
    assistant="{{content}}<end_of_turn>\n",
    system="{{content}}\n\n",
    observation="<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n",
    prefix="{{bos}}",
    stop_words=("<end_of_turn>",),
    replace_eos=True,
    system_in_first_user=True,
)
_GLM4 = Template(
    user="<|user|>\n{{content}}<|assistant|>",
    assistant="\n{{content}}",
    system="<|system|>\n{{content}}",
    function="{{content}}",
    observation="<|observation|>\n{{content}}<|assistant|>",
    prefix="[gMASK]<sop>",
    stop_words=("<|user|>", "<|observation|>"),
    tool_format="glm4",
    efficient_eos=True,
)
_LLAMA3 = Template(
    user="<|start_header_id|>user<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    assistant="{{content}}<|eot_id|>",
    system="<|start_header_id|>system<|end_header_id|>\n\n{{content}}<|eot_id|>",
    function="{{content}}<|eot_id|>",
    observation="<|start_header_id|>ipython<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    prefix="{{bos}}",
    stop_words=("<|eot_id|>", "<|eom_id|>"),
    tool_format="llama3",
    replace_eos=True,
)
_MINISTRAL = Template(
    user="[INST]{{content}}[/INST]",
    system="{{content}}\n\n",
    function="[TOOL_CALLS]{{content}}{{eos}}",
    observation='[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]',
    prefix="{{bos}}",
    tool_format="mistral",
    system_in_first_user=True,
)
_MISTRAL = replace(
    _MINISTRAL,
    user="[INST] {{content}}[/INST]",
    assistant=" {{content}}{{eos}}",
    function="[TOOL_CALLS] {{content}}{{eos}}",
    observation='[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]',
)
_LLAMA2 = Template(user="{{bos}}[INST] {{content}} [/INST]", system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", system_in_first_user=True)
_VICUNA = Template(user="USER: {{content}} ASSISTANT:", default_system=CURIOUS)
_KIMI = Template(
    user="<|im_user|>user<|im_middle|>{{content}}<|im_end|><|im_assistant|>assistant<|im_middle|>",
    assistant="{{content}}<|im_end|>",
    system="<|im_system|>system<|im_middle|>{{content}}<|im_end|>",
    stop_words=("<|im_end|>",),
)
_GRANITE = Template(
    user="<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>",
    assistant="{{content}}<|end_of_text|>\n",
    system="<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n",
)
_PHI = Template(user="<|user|>\n{{content}}<|end|>\n<|assistant|>\n", assistant="{{content}}<|end|>\n", system="<|system|>\n{{content}}<|end|>\n", stop_words=("<|end|>",), replace_eos=True)
_SEED = Template(user="{{bos}}user\n{{content}}{{eos}}{{bos}}assistant\n", system="{{bos}}system\n{{content}}{{eos}}")

TEMPLATES: dict[str, Template] = {
    "alpaca": Template("### Instruction:\n{{content}}\n\n### Response:\n", "{{content}}{{eos}}\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"),
    "aquila": Template(
        "Human: {{content}}###Assistant:",
        "{{content}}###",
        "System: {{content}}###",
        default_system="A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions.",
        stop_words=("</s>",),
    ),
    "atom": Template("{{bos}}Human: {{content}}\n{{eos}}{{bos}}Assistant:", "{{content}}\n{{eos}}"),
    "baichuan": Template("<reserved_102>{{content}}<reserved_103>", efficient_eos=True),
    "baichuan2": Template("<reserved_106>{{content}}<reserved_107>", efficient_eos=True),
    "bailing": Template(
        "<role>HUMAN</role>{{content}}<role>ASSISTANT</role>",
        system="<role>SYSTEM</role>{{content}}",
        observation="<role>OBSERVATION</role>{{content}}<role>ASSISTANT</role>",
        stop_words=("<|endoftext|>",),
        efficient_eos=True,
    ),
    "bailing_v2": Template(
        "<role>HUMAN</role>{{content}}<|role_end|><role>ASSISTANT</role>",
        "{{content}}<|role_end|>",
        "<role>SYSTEM</role>{{content}}<|role_end|>",
        "{{content}}<|role_end|>",
        "<role>OBSERVATION</role>\n<tool_response>\n{{content}}\n</tool_response><|role_end|><role>ASSISTANT</role>",
        stop_words=("<|endoftext|>",),
        tool_format="ling",
        efficient_eos=True,
    ),
    "belle": Template("Human: {{content}}\n\nBelle: ", "{{content}}{{eos}}\n\n", prefix="{{bos}}"),
    "bluelm": Template("[|Human|]:{{content}}[|AI|]:"),
    "breeze": Template("[INST] {{content}} [/INST] ", prefix="{{bos}}", efficient_eos=True),
    "chatglm2": Template("[Round {{idx}}]\n\n问：{{content}}\n\n答：", prefix="[gMASK]sop", efficient_eos=True),
    "chatglm3": Template(
        "<|user|>\n{{content}}<|assistant|>",
        "\n{{content}}",
        "<|system|>\n{{content}}",
        "{{content}}",
        "<|observation|>\n{{content}}<|assistant|>",
        prefix="[gMASK]sop",
        stop_words=("<|user|>", "<|observation|>"),
        tool_format="glm4",
        efficient_eos=True,
    ),
    "chatml": replace(_CHATML_TOOL, stop_words=("<|im_end|>", "<|im_start|>"), replace_eos=True),
    "chatml_de": replace(_CHATML_TOOL, default_system="Du bist ein freundlicher und hilfsbereiter KI-Assistent.", stop_words=("<|im_end|>", "<|im_start|>"), replace_eos=True),
    "codegeex2": Template(prefix="[gMASK]sop"),
    "codegeex4": Template(
        "<|user|>\n{{content}}<|assistant|>\n",
        system="<|system|>\n{{content}}",
        function="{{content}}",
        observation="<|observation|>\n{{content}}<|assistant|>\n",
        prefix="[gMASK]<sop>",
        default_system="你是一位智能编程助手，你叫CodeGeeX。你会为用户回答关于编程、代码、计算机方面的任何问题，并提供格式规范、可以执行、准确安全的代码，并在必要时提供详细的解释。",
        stop_words=("<|user|>", "<|observation|>"),
        tool_format="glm4",
        efficient_eos=True,
    ),
    "cohere": Template(
        "<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>",
        system="<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>",
        prefix="{{bos}}",
    ),
    "cpm": Template("<用户>{{content}}<AI>", prefix="{{bos}}"),
    "cpm3": replace(_CHATML_TOOL, prefix="{{bos}}"),
    "cpm4": replace(_CHATML_TOOL, prefix="{{bos}}"),
    "dbrx": replace(
        _CHATML_TOOL,
        default_system=(
            "You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.\n"
            "YOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.\n"
            "You assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).\n"
            "(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. "
            "You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)\n"
            "This is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. "
            "You should be responding appropriately and usually that means not mentioning this.\n"
            "YOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY."
        ),
        replace_eos=True,
    ),
    "deepseek": Template("User: {{content}}\n\nAssistant:", system="{{content}}\n\n", prefix="{{bos}}"),
    "deepseek3": Template("<｜User｜>{{content}}<｜Assistant｜>", prefix="{{bos}}"),
    "deepseekr1": Template("<｜User｜>{{content}}<｜Assistant｜>", prefix="{{bos}}", reasoning=True),
    "deepseekcoder": Template(
        "### Instruction:\n{{content}}\n### Response:",
        "\n{{content}}\n<|EOT|>\n",
        prefix="{{bos}}",
        default_system=(
            "You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. "
            "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n"
        ),
    ),
    "default": Template("Human: {{content}}{{eos}}\nAssistant:", "{{content}}{{eos}}\n", "System: {{content}}{{eos}}\n"),
    "dots_ocr": Template("<|user|>{{content}}<|endofuser|><|assistant|>", "{{content}}<|endofassistant|>", "<|system|>{{content}}<|endofsystem|>\n", stop_words=("<|endofassistant|>",), efficient_eos=True, media="qwen2_vl"),
    "empty": Template(assistant="{{content}}"),
    "ernie": Template(
        "<|im_start|>user\n{{content}}<|im_end|>\n\n<|im_start|>assistant\n",
        "{{content}}<|im_end|>\n\n",
        "<|im_start|>system\n{{content}}<|im_end|>\n\n",
        observation="<|im_start|>tool\n{{content}}<|im_end|>\n\n<|im_start|>assistant\n",
        default_system="<global_setting>\nthink_mode=True\n</global_setting>",
        stop_words=("<|im_end|>",),
    ),
    "ernie_nothink": Template("User: {{content}}\nAssistant: ", "{{content}}<|end_of_sentence|>", "{{content}}\n", prefix="<|begin_of_sentence|>", stop_words=("<|end_of_sentence|>",)),
    "ernie_vl": Template("User: {{content}}", "\nAssistant: {{content}}<|end_of_sentence|>", "{{content}}\n", stop_words=("<|end_of_sentence|>",), replace_eos=True, reasoning=True, media="ernie_vl"),
    "exaone": Template("[|user|]{{content}}\n[|assistant|]", "{{content}}{{eos}}\n", "[|system|]{{content}}[|endofturn|]\n"),
    "falcon": Template("User: {{content}}\nFalcon:", "{{content}}\n", efficient_eos=True),
    "falcon_h1": replace(_CHATML_TOOL, prefix="{{bos}}", stop_words=("<|im_end|>", "<|end_of_text|>")),
    "fewshot": Template(assistant="{{content}}\n\n", efficient_eos=True),
    "gemma": _GEMMA,
    "gemma2": replace(_GEMMA, stop_words=("<eos>", "<end_of_turn>"), replace_eos=False, efficient_eos=True),
    "gemma3": replace(_GEMMA, media="gemma3"),
    "gemma3n": replace(_GEMMA, media="gemma3n"),
    "glm4": _GLM4,
    "glm4_moe": replace(_GLM4, tool_format="glm4_moe", reasoning=True),
    "glm4v": replace(_GLM4, stop_words=("<|user|>", "<|observation|>", "</answer>"), reasoning=True, media="glm4v"),
    "glm4_5v": replace(_GLM4, tool_format="glm4_moe", stop_words=("<|user|>", "<|observation|>", "</answer>"), reasoning=True, media="glm4v"),
    "glmz1": replace(_GLM4, reasoning=True),
    "gpt": Template(
        "<|start|>user<|message|>{{content}}<|end|><|start|>assistant",
        "{{content}}<|end|>",
        "<|start|>system<|message|>{{content}}<|end|>",
        default_system="You are ChatGPT, a large language model trained by OpenAI.",
        thought=("<|channel|>analysis<|message|>", "<|end|><|start|>assistant<|channel|>final<|message|>"),
        efficient_eos=True,
        reasoning=True,
    ),
    "granite3": _GRANITE,
    "granite3_vision": Template("<|user|>\n{{content}}\n<|assistant|>\n", system="<|system|>\n{{content}}\n", default_system=CURIOUS, media="llava_next"),
    "granite4": replace(
        _GRANITE,
        function="{{content}}<|end_of_text|>\n",
        observation="<|start_of_role|>tool<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant\n",
        default_system="You are Granite, developed by IBM. You are a helpful AI assistant.",
        stop_words=("<|end_of_text|>",),
    ),
    "hunyuan": Template("{{content}}<|extra_0|>", "{{content}}<|eos|>", "{{content}}<|extra_4|>", prefix="<|startoftext|>", stop_words=("<|eos|>",)),
    "index": Template("reserved_0{{content}}reserved_1", system="<unk>{{content}}", efficient_eos=True),
    "intern": Template("<|User|>:{{content}}\n<|Bot|>:", "{{content}}<eoa>\n", "<|System|>:{{content}}\n", prefix="{{bos}}", default_system=INTERNLM, stop_words=("<eoa>",)),
    "intern2": replace(_CHATML, prefix="{{bos}}", default_system=INTERNLM),
    "intern_vl": replace(_CHATML, prefix="{{bos}}", default_system="你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。", media="intern_vl"),
    "intern_s1": replace(_CHATML, prefix="{{bos}}", media="intern_vl"),
    "keye_vl": replace(_QWEN, reasoning=True, media="qwen2_vl"),
    "kimi_vl": replace(_KIMI, default_system="You are a helpful assistant", thought=("◁think▷", "◁/think▷"), reasoning=True, media="kimi_vl"),
    "llama2": _LLAMA2,
    "llama2_zh": replace(_LLAMA2, default_system="You are a helpful assistant. 你是一个乐于助人的助手。"),
    "llama3": _LLAMA3,
    "llama4": Template(
        "<|header_start|>user<|header_end|>\n\n{{content}}<|eot|><|header_start|>assistant<|header_end|>\n\n",
        "{{content}}<|eot|>",
        "<|header_start|>system<|header_end|>\n\n{{content}}<|eot|>",
        "{{content}}<|eot|>",
        "<|header_start|>ipython<|header_end|>\n\n{{content}}<|eot|><|header_start|>assistant<|header_end|>\n\n",
        prefix="{{bos}}",
        stop_words=("<|eot|>", "<|eom|>"),
        tool_format="llama3",
        replace_eos=True,
        media="llama4",
    ),
    "llava": replace(_VICUNA, media="llava"),
    "llava_next": replace(_VICUNA, media="llava_next"),
    "llava_next_llama3": replace(_LLAMA3, media="llava_next"),
    "llava_next_mistral": replace(_MISTRAL, media="llava_next"),
    "llava_next_qwen": replace(_QWEN, default_system=HELPFUL, media="llava_next"),
    "llava_next_video": replace(_VICUNA, media="llava_next_video"),
    "llava_next_video_mistral": replace(_MISTRAL, media="llava_next_video"),
    "llava_next_video_yi": replace(_CHATML, media="llava_next_video"),
    "llava_next_yi": replace(_CHATML, media="llava_next"),
    "marco": replace(
        _CHATML_TOOL,
        default_system=(
            "你是一个经过良好训练的AI助手，你的名字是Marco-o1.由阿里国际数字商业集团的AI Business创造.\n## 重要！！！！！\n"
            "当你回答问题时，你的思考应该在<Thought>内完成，<Output>内输出你的结果。\n"
            "<Thought>应该尽可能是英文，但是有2个特例，一个是对原文中的引用，另一个是是数学应该使用markdown格式，<Output>内的输出需要遵循用户输入的语言。\n"
        ),
    ),
    "mimo": replace(_QWEN, default_system=HELPFUL, reasoning=True),
    "mimo_vl": replace(_QWEN, default_system="You are MiMo, an AI assistant developed by Xiaomi.", reasoning=True, media="qwen2_vl"),
    "minicpm_o": replace(_CHATML, default_system="You are a helpful assistant. You can accept audio and text input and output voice and text.", media="minicpm_v"),
    "minicpm_v": replace(_CHATML, default_system=HELPFUL, media="minicpm_v"),
    "ministral": _MINISTRAL,
    "ministral3": replace(_MINISTRAL, media="pixtral"),
    "mistral": _MISTRAL,
    "mistral_small": replace(_MINISTRAL, system="[SYSTEM_PROMPT]{{content}}[/SYSTEM_PROMPT]", system_in_first_user=False, media="pixtral"),
    "mllama": replace(_LLAMA3, media="mllama"),
    "moonlight": replace(_KIMI, default_system="You are a helpful assistant provided by Moonshot-AI.", replace_eos=True),
    "olmo": Template("<|user|>\n{{content}}<|assistant|>\n", prefix="{{eos}}"),
    "openchat": Template("GPT4 Correct User: {{content}}{{eos}}GPT4 Correct Assistant:", prefix="{{bos}}"),
    "openchat-3.6": Template(
        "<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n",
        prefix="{{bos}}",
        stop_words=("<|eot_id|>",),
    ),
    "opencoder": replace(_CHATML_TOOL, default_system="You are OpenCoder, created by OpenCoder Team."),
    "orion": Template("Human: {{content}}\n\nAssistant: {{eos}}", prefix="{{bos}}"),
    "paligemma": Template("{{content}}\n", prefix="{{bos}}", system_in_first_user=True, media="paligemma"),
    "paligemma_chat": replace(_GEMMA, system="{{content}}", media="paligemma"),
    "phi": _PHI,
    "phi4": Template(
        "<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>",
        "{{content}}<|im_end|>",
        "<|im_start|>system<|im_sep|>{{content}}<|im_end|>",
        stop_words=("<|im_end|>",),
        replace_eos=True,
    ),
    "phi_small": _PHI,
    "pixtral": replace(_MINISTRAL, media="pixtral"),
    "qwen": replace(_QWEN, default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant."),
    "qwen2_audio": replace(_CHATML, default_system=HELPFUL, replace_eos=True, media="qwen2_audio"),
    "qwen2_omni": replace(_QWEN, default_system=HELPFUL, media="qwen2_omni"),
    "qwen2_vl": replace(_QWEN, default_system=HELPFUL, media="qwen2_vl"),
    "qwen3": replace(_QWEN, reasoning=True),
    "qwen3_nothink": _QWEN,
    "qwen3_omni": replace(_QWEN, reasoning=True, media="qwen2_omni"),
    "qwen3_omni_nothink": replace(_QWEN, media="qwen2_omni"),
    "qwen3_vl": replace(_QWEN, reasoning=True, media="qwen3_vl"),
    "qwen3_vl_nothink": replace(_QWEN, media="qwen3_vl"),
    "sailor": replace(
        _CHATML,
        user="<|im_start|>question\n{{content}}<|im_end|>\n<|im_start|>answer\n",
        default_system="You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed.",
    ),
    "seed_coder": replace(
        _SEED,
        default_system=(
            "You are an AI programming assistant, utilizing the Seed-Coder model, developed by ByteDance Seed, and you only answer questions related to computer science. "
            "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n\n"
        ),
    ),
    "seed_oss": replace(_SEED, function="{{bos}}\n{{content}}{{eos}}", tool_format="seed_oss", thought=("<seed:think>", "</seed:think>"), reasoning=True),
    "skywork_o1": replace(
        _LLAMA3,
        default_system=(
            "You are Skywork-o1, a thinking model developed by Skywork AI, specializing in solving complex problems involving mathematics, coding, and logical reasoning through deep thought. "
            "When faced with a user's request, you first engage in a lengthy and in-depth thinking process to explore possible solutions to the problem. "
            "After completing your thoughts, you then provide a detailed explanation of the solution process in your response."
        ),
        replace_eos=False,
    ),
    "smollm": _CHATML,
    "smollm2": replace(_CHATML, default_system="You are a helpful AI assistant named SmolLM, trained by Hugging Face."),
    "solar": Template("### User:\n{{content}}\n\n### Assistant:\n", system="### System:\n{{content}}\n\n", efficient_eos=True),
    "starchat": replace(_PHI, user="<|user|>\n{{content}}<|end|>\n<|assistant|>", replace_eos=False),
    "telechat": Template("<_user>{{content}}<_bot>", system="<_system>{{content}}<_end>"),
    "telechat2": Template(
        "<_user>{{content}}<_bot>",
        system="<_system>{{content}}",
        default_system="你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。",
    ),
    "vicuna": _VICUNA,
    "video_llava": replace(_VICUNA, media="video_llava"),
    "xuanyuan": Template(
        "Human: {{content}} Assistant:",
        default_system="以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n",
    ),
    "xverse": Template("Human: {{content}}\n\nAssistant: "),
    "yayi": Template(
        "<|Human|>:\n{{content}}\n\n<|YaYi|>:",
        "{{content}}\n\n",
        "<|System|>:\n{{content}}\n\n",
        default_system=(
            "You are a helpful, respectful and honest assistant named YaYi developed by Beijing Wenge Technology Co.,Ltd. Always answer as helpfully as possible, while being safe.  "
            "Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
            "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
            "If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. "
            "If you don't know the answer to a question, please don't share false information."
        ),
        stop_words=("<|End|>",),
    ),
    "yi": _CHATML,
    "yi_vl": Template(
        "### Human: {{content}}\n### Assistant:",
        "{{content}}\n",
        default_system=(
            "This is a chat between an inquisitive human and an AI assistant. Assume the role of the AI assistant. "
            "Read all the images carefully, and respond to the human's questions with informative, helpful, detailed and polite answers. "
            "这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n"
        ),
        stop_words=("###",),
        efficient_eos=True,
        media="llava",
    ),
    "yuan": Template("{{content}}<sep>", "{{content}}<eod>\n", stop_words=("<eod>",)),
    "zephyr": Template("<|user|>\n{{content}}{{eos}}<|assistant|>\n", system="<|system|>\n{{content}}{{eos}}", default_system="You are Zephyr, a helpful assistant."),
    "ziya": Template("<human>:{{content}}\n<bot>:", "{{content}}\n"),
}
