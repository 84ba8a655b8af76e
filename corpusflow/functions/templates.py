"""Chat templates as data: slots per role, default system text and stop words.

A slot is literal text (with ``{{content}}``, ``{{idx}}``, ``{{name}}`` or ``{{arguments}}`` to fill in),
``Token(t)`` for one vocabulary token, or ``BOS`` / ``EOS`` for the sequence markers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Token(NamedTuple):
    text: str


class Marker(NamedTuple):
    name: str


BOS, EOS = Marker("bos"), Marker("eos")
CONTENT = "{{content}}"
DEFAULT_EOS = "<|endoftext|>"


@dataclass(frozen=True)
class Template:
    name: str
    user: tuple = (CONTENT,)
    assistant: tuple | None = None
    system: tuple = (CONTENT,)
    function: tuple | None = None
    observation: tuple | None = None
    separator: tuple = ()
    default_system: str = ""
    stop_words: tuple = ()
    efficient_eos: bool = False
    replace_eos: bool = False
    force_system: bool = False
    inline_system: bool = field(default=False)

    def slots(self, role: str) -> tuple:
        """Slots of a role after the fallbacks: observations look like users, others end with EOS."""
        end = () if self.efficient_eos else (EOS,)
        if role == "assistant":
            return (CONTENT, *end) if self.assistant is None else self.assistant
        if role == "function":
            return ("Action: {{name}}\nAction Input: {{arguments}}", *end) if self.function is None else self.function
        if role == "observation":
            return self.user if self.observation is None else self.observation
        return getattr(self, role)


def _t(name: str, **attrs) -> Template:
    return Template(name=name, inline_system=name.startswith("llama2"), **attrs)


_CHATML_USER = ("<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n",)
_CHATML_SYSTEM = ("<|im_start|>system\n{{content}}<|im_end|>\n",)
_BOS_SYSTEM = (BOS, CONTENT)

# Prompt formats and default system texts that models were trained with.
_BUILT_IN = [
    _t(
        "alpaca",
        user=("### Instruction:\n{{content}}\n\n### Response:\n",),
        separator=("\n\n",),
        default_system="Below is an instruction that describes a task. "
        "Write a response that appropriately completes the request.",
    ),
    _t(
        "aquila",
        user=("Human: {{content}}###Assistant:",),
        separator=("###",),
        default_system="A chat between a curious human and an artificial intelligence assistant. "
        "The assistant gives helpful, detailed, and polite answers to the human's questions.",
        stop_words=("</s>",),
        efficient_eos=True,
    ),
    _t("baichuan", user=(Token("<reserved_102>"), CONTENT, Token("<reserved_103>")), efficient_eos=True),
    _t("baichuan2", user=(Token("<reserved_106>"), CONTENT, Token("<reserved_107>")), efficient_eos=True),
    _t("belle", user=("Human: {{content}}\n\nBelle: ",), system=_BOS_SYSTEM, separator=("\n\n",), force_system=True),
    _t("bluelm", user=(Token("[|Human|]:"), CONTENT, Token("[|AI|]:"))),
    _t(
        "chatglm2",
        user=("[Round {{idx}}]\n\n问：{{content}}\n\n答：",),
        system=(Token("[gMASK]"), Token("sop"), CONTENT),
        separator=("\n\n",),
        efficient_eos=True,
        force_system=True,
    ),
    _t(
        "chatglm3",
        user=(Token("<|user|>"), "\n", CONTENT, Token("<|assistant|>")),
        assistant=("\n", CONTENT),
        system=(Token("[gMASK]"), Token("sop"), Token("<|system|>"), "\n", CONTENT),
        function=("{{name}}\n{{arguments}}",),
        observation=(Token("<|observation|>"), "\n", CONTENT, Token("<|assistant|>")),
        default_system="You are ChatGLM3, a large language model trained by Zhipu.AI. "
        "Follow the user's instructions carefully. Respond using markdown.",
        stop_words=("<|user|>", "<|observation|>"),
        efficient_eos=True,
    ),
    _t(
        "chatml",
        user=_CHATML_USER,
        system=_CHATML_SYSTEM,
        separator=("\n",),
        stop_words=("<|im_end|>", "<|im_start|>"),
        replace_eos=True,
    ),
    _t(
        "chatml_de",
        user=_CHATML_USER,
        system=_CHATML_SYSTEM,
        separator=("\n",),
        default_system="Du bist ein freundlicher und hilfsbereiter KI-Assistent.",
        stop_words=("<|im_end|>", "<|im_start|>"),
        replace_eos=True,
    ),
    _t("codegeex2", system=(Token("[gMASK]"), Token("sop"), CONTENT), force_system=True),
    _t("cpm", user=("<用户>{{content}}<AI>",), system=_BOS_SYSTEM, force_system=True),
    _t("deepseek", user=("User: {{content}}\n\nAssistant:",), system=_BOS_SYSTEM, force_system=True),
    _t(
        "deepseekcoder",
        user=("### Instruction:\n{{content}}\n### Response:",),
        assistant=("\n", CONTENT),
        separator=("\n", Token("<|EOT|>"), "\n"),
        default_system="You are an AI programming assistant, utilizing the Deepseek Coder model, "
        "developed by Deepseek Company, and you only answer questions related to computer science. "
        "For politically sensitive questions, security and privacy issues, "
        "and other non-computer science questions, you will refuse to answer\n",
        stop_words=("<|EOT|>",),
        efficient_eos=True,
    ),
    _t("default", user=("Human: {{content}}\nAssistant: ",), system=("{{content}}\n",), separator=("\n",)),
    _t("falcon", user=("User: {{content}}\nFalcon:",), separator=("\n",), efficient_eos=True),
    _t(
        "gemma",
        user=("<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n",),
        system=_BOS_SYSTEM,
        separator=("<end_of_turn>\n",),
        efficient_eos=True,
        force_system=True,
    ),
    _t(
        "intern",
        user=("<|User|>:{{content}}", Token("<eoh>"), "\n<|Bot|>:"),
        separator=(Token("<eoa>"), "\n"),
        stop_words=("<eoa>",),
        efficient_eos=True,
    ),
    _t(
        "intern2",
        user=_CHATML_USER,
        system=(BOS, *_CHATML_SYSTEM),
        separator=("\n",),
        default_system="You are an AI assistant whose name is InternLM (书生·浦语).\n"
        "- InternLM (书生·浦语) is a conversational language model that is developed "
        "by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n"
        "- InternLM (书生·浦语) can understand and communicate fluently in the language chosen "
        "by the user such as English and 中文.",
        stop_words=("<|im_end|>",),
        efficient_eos=True,
    ),
    _t(
        "llama2",
        user=(BOS, "[INST] {{content}} [/INST]"),
        system=("<<SYS>>\n{{content}}\n<</SYS>>\n\n",),
        default_system="You are a helpful, respectful and honest assistant. "
        "Always answer as helpfully as possible, while being safe. "
        "Your answers should not include any harmful, unethical, "
        "racist, sexist, toxic, dangerous, or illegal content. "
        "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
        "If a question does not make any sense, or is not factually coherent, "
        "explain why instead of answering something not correct. "
        "If you don't know the answer to a question, please don't share false information.",
    ),
    _t(
        "llama2_zh",
        user=(BOS, "[INST] {{content}} [/INST]"),
        system=("<<SYS>>\n{{content}}\n<</SYS>>\n\n",),
        default_system="You are a helpful assistant. 你是一个乐于助人的助手。",
    ),
    _t("mistral", user=("[INST] {{content}} [/INST]",), system=_BOS_SYSTEM, force_system=True),
    _t(
        "openchat",
        user=("GPT4 Correct User: {{content}}", EOS, "GPT4 Correct Assistant:"),
        assistant=(CONTENT,),
        system=_BOS_SYSTEM,
        force_system=True,
    ),
    _t("orion", user=("Human: {{content}}\n\nAssistant: ", EOS), system=_BOS_SYSTEM, force_system=True),
    _t(
        "qwen",
        user=_CHATML_USER,
        system=_CHATML_SYSTEM,
        separator=("\n",),
        default_system="You are a helpful assistant.",
        stop_words=("<|im_end|>",),
        replace_eos=True,
    ),
    _t(
        "solar",
        user=("### User:\n{{content}}\n\n### Assistant:\n",),
        system=("### System:\n{{content}}\n\n",),
        efficient_eos=True,
    ),
    _t(
        "starchat",
        user=(Token("<|user|>"), "\n{{content}}", Token("<|end|>"), "\n", Token("<|assistant|>")),
        system=(Token("<|system|>"), "\n{{content}}", Token("<|end|>"), "\n"),
        separator=("\n",),
        stop_words=("<|end|>",),
        replace_eos=True,
        force_system=True,
    ),
    _t("vanilla"),
    _t(
        "vicuna",
        user=("USER: {{content}} ASSISTANT:",),
        default_system="A chat between a curious user and an artificial intelligence assistant. "
        "The assistant gives helpful, detailed, and polite answers to the user's questions.",
    ),
    _t(
        "xuanyuan",
        user=("Human: {{content}} Assistant:",),
        default_system="以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，"
        "会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、"
        "不安全、有争议、政治敏感等相关的话题、问题和指示。\n",
    ),
    _t("xverse", user=("Human: {{content}}\n\nAssistant: ",)),
    _t(
        "yayi",
        user=(Token("<|Human|>"), ":\n{{content}}\n\n", Token("<|YaYi|>"), ":"),
        system=(Token("<|System|>"), ":\n{{content}}\n\n"),
        separator=("\n\n",),
        default_system="You are a helpful, respectful and honest assistant named YaYi "
        "developed by Beijing Wenge Technology Co.,Ltd. "
        "Always answer as helpfully as possible, while being safe.  "
        "Your answers should not include any harmful, unethical, "
        "racist, sexist, toxic, dangerous, or illegal content. "
        "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
        "If a question does not make any sense, or is not factually coherent, "
        "explain why instead of answering something not correct. "
        "If you don't know the answer to a question, please don't share false information.",
        stop_words=("<|End|>",),
    ),
    _t("yi", user=_CHATML_USER, separator=("\n",), stop_words=("<|im_end|>",), replace_eos=True),
    _t("yuan", user=(CONTENT, Token("<sep>")), separator=("\n",), stop_words=("<eod>",), replace_eos=True),
    _t(
        "zephyr",
        user=("<|user|>\n{{content}}", EOS, "<|assistant|>"),
        system=("<|system|>\n{{content}}", EOS),
        default_system="You are a friendly chatbot who always responds in the style of a pirate",
    ),
    _t("ziya", user=(Token("<human>"), ":{{content}}\n", Token("<bot>"), ":"), separator=("\n",)),
]

TEMPLATES: dict[str, Template] = {t.name: t for t in _BUILT_IN}

# Model family (name before the first "-") and the template it was trained with.
FAMILY_TEMPLATES: dict[str, str] = {
    "Baichuan": "baichuan",
    "Baichuan2": "baichuan2",
    "BlueLM": "bluelm",
    "ChatGLM2": "chatglm2",
    "ChatGLM3": "chatglm3",
    "ChineseLLaMA2": "llama2_zh",
    "DeepSeek": "deepseek",
    "DeepSeekCoder": "deepseekcoder",
    "Falcon": "falcon",
    "Gemma": "gemma",
    "InternLM": "intern",
    "InternLM2": "intern2",
    "LLaMA2": "llama2",
    "Mistral": "mistral",
    "Mixtral": "mistral",
    "OpenChat3.5": "openchat",
    "Orion": "orion",
    "Qwen": "qwen",
    "Qwen1.5": "qwen",
    "SOLAR": "solar",
    "Vicuna1.5": "vicuna",
    "XuanYuan": "xuanyuan",
    "XVERSE": "xverse",
    "Yayi": "yayi",
    "Yi": "yi",
    "Yuan2": "yuan",
    "Zephyr": "zephyr",
}
# Families without a chat template of their own.
PLAIN_FAMILIES = ("BLOOM", "BLOOMZ", "LingoWhale", "LLaMA", "Phi", "Skywork")


def register_template(template: Template, overwrite: bool = False) -> Template:
    """Add a template under its name (UDF-03)."""
    if template.name in TEMPLATES and not overwrite:
        raise ValueError(f"template {template.name!r} exists already")
    if template.replace_eos and not template.stop_words:
        raise ValueError("a template that replaces EOS needs stop words")
    TEMPLATES[template.name] = template
    return template


def get_template(name: str | None) -> Template:
    """Template by name; no name means the plain one, an unknown name is an error."""
    if name is None:
        return TEMPLATES["vanilla"]
    if name not in TEMPLATES:
        raise ValueError(f"template {name!r} does not exist")
    return TEMPLATES[name]


def special_tokens(template: Template, eos: str | None = None, bos: str | None = None, pad: str | None = None) -> dict:
    """EOS, PAD and additional tokens a vocabulary needs for a template (TPL-09)."""
    stop = list(template.stop_words)
    if template.replace_eos:
        if not stop:
            raise ValueError("a template that replaces EOS needs stop words")
        eos, stop = stop[0], stop[1:]
    eos = eos or DEFAULT_EOS
    return {"bos": bos, "eos": eos, "pad": pad or eos, "additional": stop}


_SLOT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
TEMPLATE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        *[
            T.StructField(f"{r}_slots", T.ArrayType(_SLOT))
            for r in ("user", "assistant", "system", "function", "observation", "separator")
        ],
        T.StructField("default_system", T.StringType()),
        T.StructField("stop_words", T.ArrayType(T.StringType())),
        T.StructField("efficient_eos", T.BooleanType()),
        T.StructField("replace_eos", T.BooleanType()),
        T.StructField("force_system", T.BooleanType()),
        T.StructField("inline_system", T.BooleanType()),
        T.StructField("eos", T.StringType()),
        T.StructField("pad", T.StringType()),
        T.StructField("additional_tokens", T.ArrayType(T.StringType())),
    ]
)


def _slot_row(slot) -> tuple[str, str]:
    if isinstance(slot, Token):
        return ("token", slot.text)
    if isinstance(slot, Marker):
        return (slot.name, "")
    return ("text", slot)


def templates_df(spark: SparkSession) -> DataFrame:
    """All registered templates as a table (TPL-03, TPL-09): one row each, small enough to broadcast."""
    rows = []
    for t in TEMPLATES.values():
        special = special_tokens(t)
        rows.append(
            (
                t.name,
                *[
                    [_slot_row(s) for s in t.slots(r)]
                    for r in ("user", "assistant", "system", "function", "observation", "separator")
                ],
                t.default_system,
                list(t.stop_words),
                t.efficient_eos,
                t.replace_eos,
                t.force_system,
                t.inline_system,
                special["eos"],
                special["pad"],
                special["additional"],
            )
        )
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


def families_df(spark: SparkSession) -> DataFrame:
    """Model family -> template, NULL where the family has none."""
    rows = [(f, FAMILY_TEMPLATES.get(f)) for f in [*FAMILY_TEMPLATES, *PLAIN_FAMILIES]]
    return spark.createDataFrame(rows, "family string, template string")
