"""Named variants, the two training mixtures, and set building."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lumenfold.operators import convert
from lumenfold.operators.mixing import FIRST, Mixture, subset

# Template sets that variants name (fixed values).
QA, COT, BOX_COT, POINT_COT = "VQA", "VQA_CoT", "VQA_BCoT", "VQA_PCoT"


@dataclass(frozen=True)
class Variant:
    """A converter with its version and template set, optionally on a share of its records."""

    name: str
    convert: Callable[..., DataFrame]
    templates: str | None
    version: str | None = None
    portion: float | None = None
    seed: int = 42

    def items(self, df: DataFrame, templates: Mapping[str, Sequence[str]], seed: int = 0) -> DataFrame:
        if self.portion is not None:
            df = subset(df, self.portion, seed=self.seed)
        args = [] if self.version is None else [self.version]
        if self.templates is None:
            return self.convert(df, *args)
        return self.convert(df, *args, templates=templates[self.templates], seed=seed)


def _set(*variants: Variant) -> dict[str, Variant]:
    return {v.name: v for v in variants}


_BY_ANSWER = {"a": QA, "c": COT, "s": COT, "l": COT, "bc": BOX_COT, "bs": BOX_COT, "bl": BOX_COT}
GQA = _set(*[
    Variant(f"GQA_{q.upper()}_{a.upper()}", convert.gqa, _BY_ANSWER[a], f"{q}-{a}")
    for q in ("q", "qb", "qbp") for a in ("a", "c", "bc", "s", "bs", "l", "bl")
])
CLEVR = _set(*[
    Variant(f"CLEVR_{a.upper()}", convert.clevr, t, f"q-{a}") for a, t in (("a", QA), ("s", COT), ("bs", POINT_COT))
])
GENERATED = _set(*[
    Variant(f"GPT4GEN_Q{a.upper()}", convert.gpt4gen, t, a) for a, t in (("a", QA), ("c", COT), ("bc", BOX_COT))
], Variant("GPT4GEN_RD_QBC", convert.gpt4gen, BOX_COT, "bc"))
_VCR_BOX_COT = ("q-ra", "qc-ra", "qc-rac")
VCR = _set(*[
    Variant(f"VCR_{v.replace('-', '_')}", convert.vcr, BOX_COT if v in _VCR_BOX_COT else QA, v)
    for v in ("q-a", "q-ra", "qc-a", "qc-ra", "qc-rac", "qa-r", "q-a-q-r", "qac-r", "qc-a-qc-r")
])
POINTS = _set(
    *[Variant(f"POINT_LOCAL_{r}", convert.point_qa_local, QA, r) for r in ("b", "p", "bp")],
    *[Variant(f"POINT_TWICE_{q}_{r}", convert.point_qa_twice, QA, f"{q}-{r}") for q in ("oq", "sq", "gq") for r in ("b", "p", "bp")],
    *[Variant(f"POINT_V7W_{r}", convert.v7w_point, QA, r) for r in ("p", "b")],
)
_vqa_e = lambda df, templates, seed=0: convert.vqa_ex(df, True, templates, seed=seed)
_vqa_x = lambda df, templates, seed=0: convert.vqa_ex(df, False, templates, seed=seed)
OTHERS = _set(
    Variant("VQAv2_train", convert.vqav2, QA),
    Variant("VQAE_train", _vqa_e, COT),
    Variant("VQAX_train", _vqa_x, COT),
    Variant("flickr", convert.flickr, "flickr30k"),
    Variant("rec", convert.rec, "REC"),
    Variant("recvg", convert.rec, "REC"),
    Variant("reg", convert.reg, "REG"),
    Variant("gc", convert.ground_caption, "GC"),
    Variant("caption", convert.caption, "image_cap"),
    Variant("llavacc3m", convert.instruct, None),
    Variant("llavalcs", convert.instruct, None),
    Variant("instruct", lambda df: convert.instruct(df, add_coco_prefix=True), None),
)
VARIANTS: dict[str, Variant] = {**GQA, **CLEVR, **GENERATED, **VCR, **POINTS, **OTHERS}

# Sources of the training mixtures after their few-shot sources, in order (fixed values).
SHARED_SOURCES = (
    "gc/20", "recvg/20", "llavacc3m", "llavalcs", "VQAv2_train", "VQAE_train", "VQAX_train", "caption", "rec", "reg",
    "flickr", "VCR_q_ra", "VCR_qc_rac", "VCR_qac_r", "POINT_LOCAL_b", "POINT_LOCAL_p", "POINT_TWICE_oq_bp",
    "POINT_TWICE_sq_bp", "POINT_TWICE_gq_bp", "POINT_V7W_p", "POINT_V7W_b",
)
# The two that enter as a twentieth of their records, with their own seeds.
TWENTIETHS = {
    "gc/20": Variant("gc/20", convert.ground_caption, "GC", portion=1 / 20, seed=42),
    "recvg/20": Variant("recvg/20", convert.rec, "REC", portion=1 / 20, seed=43),
}
_REST = tuple([0.5 / 21] * 21)
# The weights written for the first mixture (0.3, 0.2, 21 shares) are one more than its 22 sources;
# here its only few-shot source has the weight of both.
MIX_ONE = Mixture(("two_way_weight", *SHARED_SOURCES), (0.5, *_REST), 42, FIRST, (0,))
MIX_TWO = Mixture(("two_way_ref_or_weight", "jigsaw", *SHARED_SOURCES), (0.3, 0.2, *_REST), 42, FIRST, (0, 1))

Lazy = Callable[[], DataFrame]
SetWithMetric = tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]


def build_sets(
    train: Lazy | None = None,
    validation: Lazy | None = None,
    test: Lazy | None = None,
    multitest: Mapping[str, tuple[Lazy, Callable[[DataFrame], DataFrame] | None]] | None = None,
    metric: Callable[[DataFrame], DataFrame] | None = None,
    do_train: bool = False,
    do_eval: bool = False,
    do_predict: bool = False,
    do_multi_predict: bool = False,
) -> dict[str, SetWithMetric]:
    """The sets that the flags ask for, each with its scorer; others are not even planned."""
    wanted = {"train": (do_train, train), "validation": (do_eval, validation), "test": (do_predict, test)}
    out: dict[str, SetWithMetric] = {}
    for name, (asked, make) in wanted.items():
        if asked:
            if make is None:
                raise ValueError(f"the {name} set is asked for but not given")
            out[name] = (make(), metric)
    if do_multi_predict:
        for name, (make, scorer) in (multitest or {}).items():
            out[f"multitest_{name}"] = (make(), scorer)
    return out
