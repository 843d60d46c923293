"""Annotation records to conversation items. Every function is a row-wise projection."""

from lumenfold.operators.convert.clevr import clevr
from lumenfold.operators.convert.grounding import ground_caption, rec, reg
from lumenfold.operators.convert.gqa import gqa
from lumenfold.operators.convert.points import point_qa_local, point_qa_twice, v7w_point
from lumenfold.operators.convert.simple import caption, flickr, gpt4gen, instruct
from lumenfold.operators.convert.vcr import vcr, vcr_pred
from lumenfold.operators.convert.vqa import pope, pure_vqa, vqa_ex, vqav2

__all__ = [
    "caption", "clevr", "flickr", "gpt4gen", "gqa", "ground_caption", "instruct", "point_qa_local",
    "point_qa_twice", "pope", "pure_vqa", "rec", "reg", "v7w_point", "vcr", "vcr_pred", "vqa_ex", "vqav2",
]
