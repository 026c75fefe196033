"""Fixed values.

Everything here has to equal the values users of the original tool rely on (word lists,
labels, templates, thresholds), so it is written out plainly and in its natural order.
Operators take these as parameters; these are the defaults.
"""

# Characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Refusal cues for offline data (dataset building, validation, evaluation).
REFUSAL_CUES = (
    "无法回答", "无法据此", "无法直接", "无法确定", "无法给出", "资料不足", "没有提供", "没有关于",
    "没有相关", "未提及", "未涵盖", "建议补充", "存在冲突", "互相矛盾", "不一致", "缺少",
)

# Refusal cues for online answers (traces): a smaller list.
TRACE_REFUSAL_CUES = (
    "无法回答", "无法据此", "无法确定", "资料不足", "没有相关", "未提及", "缺少", "存在冲突", "不一致",
)

CONFLICT_CUES = ("冲突", "不一致", "矛盾")
FORMAT_CUES = ("1.", "1、", "步骤", "要点", "排查", "定义", "如下")

UNKNOWN_SOURCE = "未知来源"
NO_CONTEXT = "无可用检索资料"
SOURCE_LABEL = "来源："
CONTEXT_SECTION = "【检索资料】"
QUESTION_SECTION = "【问题】"
CONFLICT_SOURCE_SUFFIX = "（合成冲突版）"
UNKNOWN_ITEM = "UNKNOWN"

# Sample types and what each is meant to teach.
STAGE1_TYPES = ("answerable", "multi_chunk", "unanswerable", "conflicting")
STAGE1_CAPABILITIES = {
    "answerable": ("faithful", "cite"),
    "multi_chunk": ("multi_hop",),
    "unanswerable": ("refuse",),
    "conflicting": ("refuse",),
}
STAGE1_RATIOS = {"answerable": 0.35, "multi_chunk": 0.25, "unanswerable": 0.25, "conflicting": 0.15}
STAGE1_HOLDOUT = 0.15
STAGE1_SCHEMA = "stage1_question_context_answer"

GROUNDED_TYPES = ("faithful", "multi_hop", "cite", "format")
STAGE2_TYPES = ("faithful", "multi_hop", "cite", "refuse", "format")
REFUSE_SUBTYPES = ("no_recall", "weak_recall", "conflict")
STAGE2_CAPABILITIES = {
    "faithful": ("faithful", "cite"),
    "multi_hop": ("multi_hop", "cite"),
    "cite": ("cite", "faithful"),
    "format": ("format", "faithful", "cite"),
    "refuse": ("refuse",),
}
STAGE2_RATIOS = {"faithful": 0.30, "multi_hop": 0.18, "cite": 0.17, "refuse": 0.25, "format": 0.10}
STAGE2_HOLDOUT = 0.12
STAGE2_SCHEMA = "stage2_messages"

# Words that decide the subtype of a `format` sample.
TROUBLESHOOTING_WORDS = ("常见原因", "故障", "排查", "失败", "异常", "不能", "无法")
STEP_WORDS = ("步骤", "流程", "如何", "怎么", "依次", "请按")

# Query intents, tried in this order; `general` when nothing matches.
INTENT_WORDS = (
    ("image_request", ("图片", "图示", "示意图", "接线图", "外观", "结构图", "照片", "看图")),
    ("troubleshooting", ("报错", "错误", "故障", "失败", "无法", "不能", "不显示", "连不上", "异常", "告警")),
    ("install_config", ("安装", "配置", "设置", "接线", "连接", "部署", "初始化", "配网")),
    ("parameter", ("参数", "规格", "尺寸", "电压", "电流", "功率", "频率", "接口", "支持")),
    ("comparison", ("区别", "对比", "比较", "哪个好", "差异")),
    ("after_sales", ("保修", "售后", "维修", "退换", "质保")),
    ("operation", ("怎么用", "如何使用", "操作", "步骤", "测量", "打开", "关闭", "升级")),
)
GENERAL_INTENT = "general"

# Bad-case types in rule order, with severity and advice.
BAD_TYPES = (
    ("empty_answer", 3, "检查模型服务异常、超时和 AnswerOutPutNode 兜底逻辑。"),
    ("model_error", 3, "优先查看模型服务日志和请求超时配置。"),
    ("no_context_answered", 3, "检查召回为空时的拒答约束，补充 no-recall 回归样本。"),
    ("missing_citation", 2, "检查回答 prompt 的引用约束，必要时加入引用缺失回归样本。"),
    ("sft_over_refusal_candidate", 2, "人工复核是否误拒；如确认误拒，降低拒答样本比例或补充可回答样本。"),
    ("high_latency", 2, "检查 prompt 长度、模型服务负载和 max_tokens 配置。"),
    ("long_prompt", 1, "检查 context packing、top-k 和 max_context_chars。"),
    ("short_answer", 1, "人工复核回答是否不完整，必要时补 format / completeness 样本。"),
)
ADVICE_SEPARATOR = "；"
GOLDEN_LABEL_FIELDS = ("question", "ground_truth", "expected_sources", "category")

# Evaluation metrics in report order.
METRIC_LABELS = (
    ("refusal_recall", "拒答 Recall"),
    ("refusal_precision", "拒答 Precision"),
    ("refusal_f1", "拒答 F1"),
    ("false_refusal", "误拒率"),
    ("recall_no_recall", "no_recall Recall"),
    ("recall_weak_recall", "weak_recall Recall"),
    ("recall_conflict", "conflict Recall"),
    ("citation_validity", "引用有效率"),
    ("faithfulness", "忠实性"),
    ("completeness", "完整性"),
)
CONSTANT_PREDICTION = "根据资料，相关内容如上所述 [1]。"

# Offline wording of questions and answers when no generated text is supplied.
S1_ANSWERABLE_Q = "关于{topic}，{title}是怎样的？"
S1_ANSWERABLE_TITLE = "这部分内容"
S1_ANSWERABLE_A = "根据资料，{text} [C1]。"
S1_MULTI_Q = "请综合说明{item}的相关信息。"
S1_UNANSWERABLE_Q = "{item}的保修期限是多久？"
S1_UNANSWERABLE_A = (
    "现有资料只包含与「{other}」相关的内容，没有关于「{item}」保修期限的信息，我无法据此回答。建议补充对应资料后再确认。"
)
S1_CONFLICT_TITLE = "相关参数"
S1_CONFLICT_Q = "关于{topic}，{title}的数值是多少？"
S1_CONFLICT_A = (
    "现有资料存在冲突：一处为 {old} [C1]，另一处为 {new} [C2]，数值不一致，无法直接给出确定答案，建议以最新生效资料为准。"
)
S2_MULTI_Q = "请综合说明这些资料中的关键要求。"
S2_FORMAT_Q = "这部分内容应该如何操作或理解？"
S2_FORMAT_A = "可按以下要点处理：\n1. {text} [1]。"
S2_CITE_Q = "资料中的关键依据是什么？"
S2_CITE_A = "资料中的关键依据是：{text} [1]。"
S2_FAITHFUL_Q = "这条资料具体说明了什么？"
S2_FAITHFUL_A = "根据资料，{text} [1]。"
S2_CONFLICT_Q = "这些资料中的数值到底以哪个为准？"
S2_CONFLICT_A = (
    "检索到的资料存在冲突：片段 [1] 为 {old}，片段 [2] 为 {new}，两者不一致，无法直接给出确定答案。建议核对最新有效资料后再确认。"
)
S2_REFUSE_Q = "这款产品的保修期限和售后政策是什么？"
S2_REFUSE_A = "现有检索资料没有提供该问题所需的保修期限或售后政策信息，无法据此回答。建议补充对应资料后再确认。"
S2_REFUSE_FALLBACK_Q = "这个问题如何处理？"
S2_REFUSE_FALLBACK_A = "现有检索资料无法回答这个问题，缺少对应的产品说明或参数依据，建议补充相关资料后再确认。"

# Words of a linearised table.
TABLE_WORDS = {"key": "未知属性", "value": "无", "subject": "未知项目", "column": "属性"}
TABLE_EMPTY_VALUES = ("-", "/", "\\", "无")

# Chunking limits and separators, in the order they are tried.
MAX_SECTION = 2000
MIN_SECTION = 500
TITLE_PREFIX = 80
IMAGE_CONTEXT = 200
SPLIT_SEPARATORS = ("\n\n", "\n", "。", "？", "！", "，", "?", "!", ";", " ", "")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")

# Neutral default prompts; callers pass their own.
SYSTEM_PROMPT = "Answer only from the given material, cite it by number, and decline when it is not enough."
