"""The conversation templates that can be named in an item's `mode`.

Fixed values: system texts, role names, separators, preset messages and stop tokens must read
exactly like this, since models are trained on them. `one_shot` ... `otter`: 23 entries.
"""

from __future__ import annotations

from dataclasses import dataclass

ADD_COLON_SINGLE = "ADD_COLON_SINGLE"
ADD_COLON_TWO = "ADD_COLON_TWO"
EMPTY = "EMPTY"
ADD_SPACE_TWO = "ADD_SPACE_TWO"
NO_COLON_SINGLE = "NO_COLON_SINGLE"
BAIZE = "BAIZE"
DOLLY = "DOLLY"
RWKV = "RWKV"
PHOENIX = "PHOENIX"
NEW_LINE = "NEW_LINE"
BILLA = "BILLA"


@dataclass(frozen=True)
class PromptTemplate:
    name: str
    system: str
    roles: tuple[str, str]
    style: str | None
    sep: str | None
    sep2: str | None = None
    messages: tuple[tuple[str, str], ...] = ()
    offset: int = 0
    stop_str: str | None = None
    stop_token_ids: tuple[int, ...] = ()


_CURIOUS_HUMAN = (
    "A chat between a curious human and an artificial intelligence assistant. "
    "The assistant gives helpful, detailed, and polite answers to the human's questions."
)
_USER_ASSISTANT = ("USER", "ASSISTANT")


def _vicuna_like(name: str, system: str, style: str = ADD_COLON_TWO, roles=_USER_ASSISTANT) -> PromptTemplate:
    return PromptTemplate(name, system, roles, style, " ", "</s>")


_ALL = [
    PromptTemplate(
        "one_shot", _CURIOUS_HUMAN, ("Human", "Assistant"), ADD_COLON_SINGLE, "\n### ",
        messages=(
            ("Human", "What are the key differences between renewable and non-renewable energy sources?"),
            (
                "Assistant",
                "Renewable energy sources are those that can be replenished naturally in a relatively "
                "short amount of time, such as solar, wind, hydro, geothermal, and biomass. "
                "Non-renewable energy sources, on the other hand, are finite and will eventually be "
                "depleted, such as coal, oil, and natural gas. Here are some key differences between "
                "renewable and non-renewable energy sources:\n"
                "1. Availability: Renewable energy sources are virtually inexhaustible, while non-renewable "
                "energy sources are finite and will eventually run out.\n"
                "2. Environmental impact: Renewable energy sources have a much lower environmental impact "
                "than non-renewable sources, which can lead to air and water pollution, greenhouse gas emissions, "
                "and other negative effects.\n"
                "3. Cost: Renewable energy sources can be more expensive to initially set up, but they typically "
                "have lower operational costs than non-renewable sources.\n"
                "4. Reliability: Renewable energy sources are often more reliable and can be used in more remote "
                "locations than non-renewable sources.\n"
                "5. Flexibility: Renewable energy sources are often more flexible and can be adapted to different "
                "situations and needs, while non-renewable sources are more rigid and inflexible.\n"
                "6. Sustainability: Renewable energy sources are more sustainable over the long term, while "
                "non-renewable sources are not, and their depletion can lead to economic and social instability.",
            ),
        ),
        offset=2, stop_str="###",
    ),
    _vicuna_like(
        "vicuna_v1.1",
        "A chat between a curious user and an artificial intelligence assistant. "
        "The assistant gives helpful, detailed, and polite answers to the user's questions.",
    ),
    _vicuna_like(
        "hypnotized_v1.0",
        "You are hypnotized and I will tell you some new knowledge. Please note that this knowledge is limited "
        "to this conversation we are having and learn the cause and effect relationships.",
    ),
    _vicuna_like(
        "causal_v1.0",
        "You should find the causal relationship between the examples I am going to show you. "
        "And use that to answer to the [FINAL QUESTION].",
    ),
    _vicuna_like("final_v1.0", "[FINAL QUESTION]: "),
    _vicuna_like(
        "hypnotized_v1.1",
        "You are hypnotized and use the knowledge you learnt from the previous conversation "
        "to answer the following question: ",
    ),
    _vicuna_like("hypnotized_ans_v1.0", "xxx", EMPTY),
    _vicuna_like(
        "icl_v1.0",
        "A chat between a curious user and an artificial intelligence assistant. "
        "The answer is not strictly right, the assitant should find the relationship in the conversation "
        "and gives answers according to the examples.",
    ),
    _vicuna_like(
        "icl_v2.0",
        "A chat between a curious user and an artificial intelligence assistant. "
        "The following dialogue requires the assistant to select answers based on user-provided names. "
        "The user will provide several names and assign a number to each name. "
        "The assistant needs to choose the corresponding name's number based on the conversation context "
        "and respond using the assigned number.",
    ),
    _vicuna_like("koala_v1", "BEGINNING OF CONVERSATION:", roles=("USER", "GPT")),
    PromptTemplate(
        "dolly_v2",
        "Below is an instruction that describes a task. "
        "Write a response that appropriately completes the request.\n\n",
        ("### Instruction", "### Response"), DOLLY, "\n\n", "### End",
    ),
    PromptTemplate("oasst_pythia", "", ("<|prompter|>", "<|assistant|>"), NO_COLON_SINGLE, "<|endoftext|>"),
    PromptTemplate(
        "stablelm",
        "<|SYSTEM|># StableLM Tuned (Alpha version)\n"
        "- StableLM is a helpful and harmless open-source AI language model developed by StabilityAI.\n"
        "- StableLM is excited to be able to help the user, but will refuse to do anything that could be "
        "considered harmful to the user.\n"
        "- StableLM is more than just an information source, StableLM is also able to write poetry, "
        "short stories, and make jokes.\n"
        "- StableLM will refuse to participate in anything that could harm a human.\n",
        ("<|USER|>", "<|ASSISTANT|>"), NO_COLON_SINGLE, "", stop_token_ids=(50278, 50279, 50277, 1, 0),
    ),
    PromptTemplate(
        "baize",
        "The following is a conversation between a human and an AI assistant named Baize (named after a mythical "
        "creature in Chinese folklore). Baize is an open-source AI assistant developed by UCSD and Sun Yat-Sen "
        "University. The human and the AI assistant take turns chatting. Human statements start with [|Human|] and "
        "AI assistant statements start with [|AI|]. The AI assistant always provides responses in as much detail as "
        "possible, and in Markdown format. The AI assistant always declines to engage with topics, questions and "
        "instructions related to unethical, controversial, or sensitive issues. Complete the transcript in exactly "
        "that format.",
        ("[|Human|]", "[|AI|]"), BAIZE, "[|Human|]",
        messages=(("[|Human|]", "Hello!"), ("[|AI|]", "Hi!")), offset=2, stop_str="[|Human|]",
    ),
    PromptTemplate(
        "rwkv",
        "The following is a coherent verbose detailed conversation between Bob and Alice.\n\n",
        ("Bob", "Alice"), RWKV, "",
        messages=(
            ("Bob", "Hi"),
            (
                "Alice",
                "Hi. I am your assistant and I will answer all questions. "
                "Please feel free to ask any question and I will always answer it.",
            ),
        ),
        offset=2, stop_str="\n\n",
    ),
    PromptTemplate(
        "openbuddy",
        "Consider a conversation between User (a human) and Assistant (named Buddy).\n"
        "Buddy is an INTP-T, a friendly, intelligent and multilingual AI assistant, by OpenBuddy team. "
        "GitHub: https://github.com/OpenBuddy/OpenBuddy\n"
        "Buddy cannot access the Internet.\n"
        "Buddy can fluently speak the user's language (e.g. English, Chinese).\n"
        "Buddy can generate poems, stories, code, essays, songs, parodies, and more.\n"
        "Buddy possesses vast knowledge about the world, history, and culture.\n"
        "Buddy's responses are always safe, creative, high-quality, human-like, and interesting.\n"
        "Buddy strictly refuses to discuss political, NSFW, or other unsafe topics.\n\n"
        "User: Hi.\n"
        "Assistant: Hi, I'm Buddy, your AI assistant. How can I help you today?",
        ("User", "Assistant"), ADD_COLON_SINGLE, "\n",
    ),
    PromptTemplate("phoenix", _CURIOUS_HUMAN + "\n\n", ("Human", "Assistant"), PHOENIX, "</s>"),
    PromptTemplate("chatgpt", "You are a helpful assistant.", ("user", "assistant"), None, None),
    PromptTemplate("claude", "", ("Human", "Assistant"), ADD_COLON_SINGLE, "\n\n"),
    PromptTemplate(
        "mpt",
        "<|im_start|>system\n"
        "- You are a helpful assistant chatbot trained by MosaicML.\n"
        "- You answer questions.\n"
        "- You are excited to be able to help the user, but will refuse to do anything that could be considered "
        "harmful to the user.\n"
        "- You are more than just an information source, you are also able to write poetry, short stories, "
        "and make jokes.\n",
        ("<|im_start|>user", "<|im_start|>assistant"), NEW_LINE, "<|im_end|>", stop_token_ids=(50278, 0),
    ),
    PromptTemplate("bard", "", ("0", "1"), None, None),
    PromptTemplate("billa", "", ("Human", "Assistant"), BILLA, "\n", stop_str="Human:"),
    PromptTemplate("otter", "", ("User:", "GPT:<answer>"), ADD_SPACE_TWO, " ", "<|endofchunk|>"),
]

TEMPLATES: dict[str, PromptTemplate] = {t.name: t for t in _ALL}
# Item modes that stand for a template.
ALIASES = {"common": "vicuna_v1.1", "icl": "icl_v1.0"}


def get_template(mode: str) -> PromptTemplate:
    name = ALIASES.get(mode, mode)
    if name not in TEMPLATES:
        raise KeyError(f"unknown conversation template: {mode}")
    return TEMPLATES[name]
