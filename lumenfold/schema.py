"""Record types: the conversation item all converters emit, and the annotation files they read.

Everything is given as Spark DDL so that it can be passed straight to `spark.read.schema`.
"""

from __future__ import annotations

# Placeholders and markers found in texts (fixed values).
IMAGE = "<image>"
BOXES = "<boxes>"
POINTS = "<points>"
EXPR = "<expr>"
OBJS = "<objs>"
QUESTION = "<question>"
PHRASE_START = "<ph_st>"
PHRASE_END = "<ph_ed>"
LABEL = "<label>"
IM_START = "<im_start>"
IM_PATCH = "<im_patch>"
IM_END = "<im_end>"
IGNORE_INDEX = -100

BOX_LIST = "array<array<double>>"
SEQ = "array<array<int>>"
TURN = f"struct<from:string,value:string,boxes_seq:{SEQ},points_seq:{SEQ}>"
TURNS = f"array<{TURN}>"
TARGET = f"struct<boxes:{BOX_LIST},points:{BOX_LIST}>"
EPISODE_ITEM = "struct<image:string,question:string,answer:string,mode:string>"

# Columns every converter returns.
ITEM_COLUMNS = ["row_id", "image", "target", "conversations"]

# Annotation files, one JSON object per line unless noted.
CAPTION = "img_path string, caption string"
EXPRESSION = "img_path string, expression string, bbox array<double>"
ENTITIES = f"id bigint, image_id string, boxes {BOX_LIST}, sentence string, boxes_seq {SEQ}"
GENERATED_QA = (
    f"img_path string, boxes {BOX_LIST}, question string, question_boxes_seq {SEQ}, answer string, "
    f"cot_with_ans string, answer_boxes_seq {SEQ}"
)
GQA = (
    "imageId string, question string, answer string, fullAnswer string, semanticStr string, "
    f"cot struct<value:string,boxes:{BOX_LIST},seq:{SEQ}>, "
    "annotations struct<question:map<string,string>,fullAnswer:map<string,string>>"
)
GQA_SCENE = "objects map<string,struct<x:int,y:int,w:int,h:int>>"
CLEVR = (
    "image_index bigint, image_filename string, question string, answer string, "
    "program array<struct<function:string,inputs:array<int>,value_inputs:array<string>,ans:array<int>>>"
)
CLEVR_SCENE = "objects array<struct<pixel_coords:array<double>>>"
# Sentences of VCR mix words and index lists, so they stay JSON text until parsed as variants.
VCR = (
    f"img_fn string, boxes {BOX_LIST}, question string, answer_choices array<string>, "
    "rationale_choices array<string>, answer_label int, rationale_label int"
)
POINT_LOCAL = "file_path string, question string, answer string, bbox array<double>, point array<double>"
POINT_TWICE = (
    "file_path string, obj_question string, super_question string, general_question string, "
    "answer string, bbox array<double>, point array<double>"
)
V7W = f"file_path string, question string, candidates {BOX_LIST}, point array<double>, answer array<double>"
VQA2 = "image_path string, question string, annotation struct<multiple_choice_answer:string>"
VQA_E = "file_path string, question string, explanation array<string>, multiple_answers string"
VQA_X = "file_path string, question string, justification array<string>, multiple_choice_answer string"
POPE = "image string, text string, label string"
PURE_VQA = "image_path string, question string"
INSTRUCT = "image string, conversations array<struct<from:string,value:string>>"
CLASS_TRAIN = (
    "class_id string, class_name string, samples array<string>, "
    "neighbors array<struct<id:string,name:string,img:string>>"
)
CLASS_TEST = "class_id string, class_name string, context_samples array<string>, test_samples array<string>"
PAIR = (
    "image_name string, positive_list array<string>, negative_list array<string>, "
    "positive_promt string, negative_promt string, label_name string"
)
PREDICTION = "pred string, target string"
DETECTION = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, "
    "categories array<struct<id:bigint,name:string,cat_info:string>>, "
    "neighbors map<string,array<bigint>>, expired_imgs map<string,string>"
)
ENTITY_XML = (
    "filename string, size struct<width:int,height:int,depth:int>, "
    "object array<struct<name:array<string>,"
    "bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>,scene:int,nobndbox:int>>"
)
