"""Fixed values of the annotation data model, and its schemas."""

# Closed vocabularies.
ROOM_TYPES = ["kitchen", "bedroom", "living room", "bathroom", "NA"]
CAPTURE_TYPES = ["overview", "group", "closeup"]
SCENE_CAPTURES = ["overview", "group"]
SPLITS = ["train", "val", "test"]
SCHEMA_VERSION = "2.0"

# Fixed values: (slot, type, question field, answer field) of both tracks.
SCENE_SLOTS = [(1, "scene_id", "q_scene", "a_scene"), (2, "object", "q_object", "a_object"), (3, "spatial", "q_spatial", "a_spatial"), (4, "count", "q_count", "a_count"), (5, "assistive", "q_assistive", "a_assistive")]
OBJECT_SLOTS = [(1, "obj_name", "q_obj_name", "a_obj_name"), (2, "obj_function", "q_obj_function", "a_obj_function"), (3, "obj_property", "q_obj_hazard", "a_obj_hazard")]

# Answer groups, type aliases and expected counts.
GROUPS = {"scene_id": "A", "object": "A", "spatial": "A", "count": "A", "obj_name": "A", "obj_property": "A", "obj_function": "B", "assistive": "B"}
TYPE_ALIASES = {"obj_hazard": "obj_property"}
EXPECTED_COUNTS = {"scene_id": 2529, "object": 2529, "spatial": 2529, "count": 2529, "obj_name": 1877, "obj_property": 1877, "obj_function": 1877, "assistive": 2529}
EXPECTED_QA, EXPECTED_IMAGES = 18276, 4406

# Names under which containers and fields are looked for, in order.
RECORD_KEYS = ["records", "data", "images", "annotations", "items", "dataset", "entries"]
QA_KEYS = ["qa_pairs", "qa", "qas", "qa_list", "questions", "question_answers", "pairs"]
TYPE_KEYS = ["qa_type", "type", "q_type", "question_type", "slot", "slot_type"]
QUESTION_KEYS = ["question", "question_bn", "q", "prompt", "text"]
ANSWER_KEYS = ["answer", "answer_bn", "a", "gold", "gt", "reference"]
QA_ID_KEYS = ["qa_id", "qaid", "qid", "id"]
IMAGE_ID_KEYS = ["image_id", "img_id", "imageId", "image", "id"]
HOUSE_ID_KEYS = ["house_id", "houseId", "house"]
IMAGE_FILE_KEYS = ["image_file", "file_name", "filename", "image_path", "img_path", "file", "path", "image_filename", "image"]

# Limits.
MIN_BOX_AREA_PCT, MIN_BOX_SIDE_PX = 15.0, 16
LONG_EDGE_PX, SHORT_SIDE_PX, GUARD_PX = 2048, 768, 768
INGEST_QUALITY, RESIZE_QUALITY = 95, 92
GROUP_A_TOKENS, GROUP_B_TOKENS, LONG_ANSWER_WORDS, WARM_UP = 32, 96, 12, 3
INGEST_EXTENSIONS = [".jpg", ".jpeg", ".png", ".heic", ".heif"]
RESIZE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff"]

# Known model paths and their tags.
MODEL_TAGS = {
    "google/gemma-3-12b-it": "gemma3-12b",
    "google/gemma-3-4b-it": "gemma3-4b",
    "Qwen/Qwen3-VL-8B-Instruct": "qwen3vl-8b",
    "Qwen/Qwen3-VL-4B-Instruct": "qwen3vl-4b",
    "OpenGVLab/InternVL3_5-8B-HF": "internvl3_5-8b",
    "OpenGVLab/InternVL3_5-4B-HF": "internvl3_5-4b",
}

# Schemas of the files that are read and written.
MANIFEST = "image_id string, house_id string, original_filename string, original_relpath string, original_format string, orig_width int, orig_height int, final_width int, final_height int, orientation string, room_type string, capture_type string, include_flag string, exclude_reason string, has_face string, notes string"
BOX = "struct<object_id:string,bangla_name:string,bbox:array<int>,bbox_pct:array<double>>"
QA = "struct<qa_id:string,type:string,question:string,answer:string>"
RELEASE = f"image_id string, house_id string, annotator_id string, image_file string, image_w int, image_h int, capture_type string, room_type string, objects array<{BOX}>, qa_pairs array<{QA}>"
ITEMS = "rank long, qa_id string, image_id string, house_id string, image_file string, qa_type string, group string, question string, gold string"
RESPONSES = "qa_id string, model_id string, raw_output string, latency_s double, run_ts string"
TASK = (
    "struct<id:string,file_upload:string,data:struct<image:string>,annotations:array<struct<was_cancelled:boolean,result:array<struct<from_name:string,id:string,type:string,"
    "original_width:int,original_height:int,value:struct<choices:array<string>,text:variant,x:double,y:double,width:double,height:double>>>>>>"
)
