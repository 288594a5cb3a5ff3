"""Names, limits and texts that must be exactly these for the results to be right."""

RATING_GROUP = "rating"
DEFAULT_GROUP = "general"

# Source category number -> group id; every other number goes to DEFAULT_GROUP.
CATEGORY_GROUPS = {9: "rating", 1: "artist", 3: "copyright", 4: "character", 0: "general"}
CANONICAL_GROUPS = ["rating", "artist", "copyright", "character", "general"]

# File extensions accepted by the import, and container formats accepted after sniffing.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff"]
IMAGE_FORMATS = ["jpeg", "png", "webp", "bmp", "gif", "tiff"]

ANALYSIS_STATES = ["not_run", "queued", "running", "succeeded", "failed", "canceled", "stale"]

# Metadata limits in UTF-16 units, and the JSON nesting limit.
MAX_FIELD_UNITS = 2 * 1024 * 1024
MAX_TOTAL_UNITS = 8 * 1024 * 1024
MAX_JSON_DEPTH = 64

QUALITY_TAGS = {
    "none": "",
    "stable_diffusion": "masterpiece, best quality",
    "sdxl": "masterpiece, best quality",
    "pony": "score_9, score_8_up, score_7_up, score_6_up",
    "illustrious": "masterpiece, best quality, amazing quality, very aesthetic",
    "noob_ai": "masterpiece, best quality, newest, absurdres, highres",
    "anima": "masterpiece, best quality, score_7",
}

EMOTICON_CHARS = "xXoO0:;=^vTt_()[]<>-"

# Parameter text: markers and tail-field spellings -> parameter name.
NEGATIVE_MARKER = "Negative prompt:"
TAIL_MARKER = "Steps:"
TAIL_FIELDS = {
    "steps": "steps",
    "sampler": "sampler",
    "scheduler": "scheduler",
    "schedule type": "scheduler",
    "schedule": "scheduler",
    "cfg scale": "cfg",
    "cfg": "cfg",
    "seed": "seed",
    "size": "size",
    "model hash": "model_hash",
    "model": "model",
    "vae": "vae",
    "vae hash": "vae_hash",
    "clip skip": "clip_skip",
    "clipskip": "clip_skip",
    "denoising strength": "denoising",
    "version": "version",
    "face restoration": "face_restoration",
    "tiling": "tiling",
}

# Node JSON: sampler input -> parameter name.
SAMPLER_FIELDS = {
    "seed": "seed",
    "steps": "steps",
    "cfg": "cfg",
    "sampler_name": "sampler",
    "scheduler": "scheduler",
    "denoise": "denoise",
}

COMMENT_TAGS = ["comment", "imagedescription", "description", "usercomment", "xpcomment"]

SOURCE_BADGES = {
    "automatic1111": "AUTOMATIC1111",
    "forge": "Forge",
    "comfyui": "ComfyUI",
    "novelai": "NovelAI",
}
UNKNOWN_BADGE = "未发现生成信息"

# Warning texts, with %s where a key or number goes.
W_JSON_FAILED = "JSON解析失败或深度超限（键“%s”），已保留原文。"
W_NO_TAIL = "未找到尾部参数行，仅保留提示词。"
W_UNKNOWN_FIELD = "未识别尾部字段“%s”，已保留原文。"
W_PROMPT_JSON = "prompt JSON解析失败或深度超限，已保留原文。"
W_WORKFLOW_JSON = "workflow JSON解析失败或深度超限，已保留原文。"
W_ROOT_NOT_OBJECT = "prompt JSON根不是对象，已保留原文。"
W_TEXT_NODE = "文本编码节点“%s”缺少可证实的text值。"
W_WORKFLOW_SAMPLER = "workflow格式的采样器节点位置不确定，未推断其组合。"
W_COMPLEX = "工作流复杂，仅展示可证实节点值，未推断最终组合顺序。"
W_MANY_SAMPLERS = "存在多个KSampler节点，仅保留首个可证实值。"
W_MANY_TEXTS = "存在多个文本编码节点，仅保留前两个。"
W_COMMENT_NOT_OBJECT = "Comment不是JSON对象，已保留原文。"
W_COMMENT_JSON = "Comment JSON解析失败或深度超限，已保留原文。"
W_NOT_NOVELAI = "未识别为NovelAI，已保留原始键值。"
W_UNSUPPORTED = "未发现支持的AI生成信息，已列出发现的元数据键。"
W_MULTI_SOURCE = "发现多套来源信息，已合并展示。"
W_FIELD_CUT = "字段“%s”超过%s，已截断展示。"
W_BUDGET = "原始文本总和超过%s，已截断保留前%s个字段。"
L_PARAMETER = "参数%s"
L_POSITIVE = "正向提示词"
L_NEGATIVE = "负向提示词"

# Display texts.
NO_TRANSLATION = "暂无翻译"
STATE_TEXTS = {
    "not_run": "未识别",
    "queued": "排队中",
    "running": "识别中",
    "succeeded": "已识别 %s 个标签",
    "failed": "识别失败",
    "canceled": "已取消",
    "stale": "模型已变更",
}
UNKNOWN_STATE_TEXT = "未知状态"
SIZE_UNITS = ["B", "KiB", "MiB", "GiB"]

ERROR_TEXTS = {
    "model_pack_invalid": "模型包无效，无法加载",
    "model_pack_corrupt": "模型文件已损坏，建议重新安装应用",
    "model_incompatible": "模型与当前应用不兼容",
    "image_unsupported": "图片格式不受支持",
    "image_corrupt": "图片已损坏，无法读取",
    "inference_failed": "识别失败，请重试",
    "out_of_memory": "内存不足，已停止当前任务",
    "provider_unavailable": "硬件加速不可用，已回退到 CPU",
    "settings_corrupt": "设置已损坏，已恢复默认",
    "io_error": "文件读写失败",
    "canceled": "操作已取消",
}
UNKNOWN_ERROR_TEXT = "发生未知错误"
ERRORS_ONE_CODE = "%s（共 %s 项）"
ERRORS_MANY_CODES = "批量任务中有 %s 项失败：%s"
ERRORS_PART = "%s %s 项"
MERGED_REPEATS = "%s（另有 %s 条重复已合并）"

FAILURE_TEXTS = {
    "blank": "文件路径为空。",
    "missing": "文件或目录不存在。",
    "extension": "不支持该文件扩展名。",
    "container": "不是支持的图片格式。",
    "corrupt": "图片内容已损坏或不完整。",
    "denied": "没有权限读取该文件。",
    "io": "读取图片时发生文件错误。",
}

# Pack rules.
PACK_FILES = ["model.onnx", "model.json", "tags.csv", "checksums.sha256", "LICENSE.txt"]
HASHED_FILES = ["model.onnx", "model.json", "tags.csv", "LICENSE.txt"]
MODEL_TASK = "multi-label-image-tagging"
GROUP_STRATEGIES = ["threshold", "rating"]
ACTIVATIONS = ["sigmoid", "none"]
GROUP_ID_PATTERN = "^[a-z][a-z-]*$"

#: The preparation steps of the published pack format.
STANDARD_STEPS = [
    {"op": "decode", "frame": "first", "colorManagement": "ignore"},
    {"op": "exif-transpose"},
    {"op": "ensure-color", "mode": "rgb-or-rgba-if-transparent"},
    {"op": "alpha-composite", "when": "has-alpha", "background": [255, 255, 255]},
    {"op": "pad-to-square", "anchor": "floor-center", "background": [255, 255, 255]},
    {"op": "resize", "width": 448, "height": 448, "sampler": "pillow-bicubic-v1"},
    {"op": "reorder-channels", "order": [2, 1, 0]},
    {"op": "cast", "dtype": "float32"},
    {"op": "divide", "value": 255},
    {"op": "normalize", "mean": [0.5, 0.5, 0.5], "std": [0.5, 0.5, 0.5]},
    {"op": "permute", "order": [2, 0, 1]},
]
