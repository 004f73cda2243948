"""Word lists, patterns, thresholds and labels of the power-standard domain.

They must equal the published values for results to agree; everything here is data and can
be replaced by a caller's own lists.
"""

# --- fixed values: document structure patterns -------------------------------------------
CHAPTER_PATTERNS = [
    r"^#\s+第\s*[0-9]+\s*章",
    r"^第\s*[0-9]+\s*章",
    r"^[0-9]+\s+[^0-9.]",
    r"^#{1,2}\s+[0-9]+\s+[^0-9.]",
]
SECTION_PATTERNS = [r"^##\s+第?\s*[0-9]+\.[0-9]+\s*节", r"^第?\s*[0-9]+\.[0-9]+\s*节"]
CLAUSE_PATTERNS = [
    r"^#{2,4}\s+[0-9]+\.[0-9]+",
    r"^#{2,4}\s*[0-9]{2,5}(?:\.[0-9]+)?",
    r"^[0-9]+\.[0-9]+\.[0-9]+\s",
    r"^[0-9]+\.[0-9]+\s+[^0-9]",
]

# --- fixed values: standard numbers and clauses ------------------------------------------
QUERY_STANDARD_PATTERNS = [
    r"(?i)(GB(?:/T)?\s*[0-9]+(?:-[0-9]+)?)",
    r"(?i)(DL(?:/T)?\s*[0-9]+(?:-[0-9]+)?)",
    r"(?i)(NB(?:/T)?\s*[0-9]+(?:-[0-9]+)?)",
]
FILTER_STANDARD_PATTERNS = [
    r"(?i)GB\s*/?\s*T?\s*[0-9]+(?:\.[0-9]+)?(?:-[0-9]{4})?",
    r"(?i)DL\s*/?\s*T\s*[0-9]+(?:\.[0-9]+)?(?:-[0-9]{4})?",
    r"(?i)NB\s*/?\s*T\s*[0-9]+(?:\.[0-9]+)?(?:-[0-9]{4})?",
]
REFERENCE_STANDARD_PATTERN = r"(?i)(GB|DL|NB)((?:[/\s]*T)?)\s*([0-9]+)(?:[-–—]([0-9]+))?"
CLAUSE_NUMBER_PATTERN = r"第?([0-9]+(?:\.[0-9]+)+)条?"
FILENAME_STANDARD_PATTERN = (
    r"(?i)(GB|DL|NB|JB|HG)[\s_/\\+]*(/T|T)?[\s_]*([0-9]+(?:\.[0-9]+)?)[_\s\-—]*([0-9]{4})"
)
FILENAME_COMPANY_PATTERN = r"(?i)(Q/[A-Za-z0-9]+)[_\s\-—]*([0-9]{4})"
CONTENT_STANDARD_PATTERN = (
    r"(GB|DL|NB|JB|HG)[\s/]*(/T|T)?[\s]*([0-9]+(?:\.[0-9]+)?)[\s—\-~～]+([0-9]{4})"
)
CONTENT_COMPANY_PATTERN = r"(Q/[A-Za-z0-9]+)[\s—\-~～]+([0-9]{4})"
COVER_TITLES = ["中华人民共和国国家标准", "国家标准", "行业标准", "电力行业标准"]
DATE_PATTERNS = {
    "publish_date": [
        r"([0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2})\s*发布",
        r"发布日期[：:]\s*([0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2}日?)",
    ],
    "implement_date": [
        r"([0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2})\s*实施",
        r"实施日期[：:]\s*([0-9]{4}[-年][0-9]{1,2}[-月][0-9]{1,2}日?)",
    ],
}
PUBLISHER_PATTERNS = [
    r"发布(?:单位|机构)[：:]\s*([^\n]+)",
    r"本标准由([^提]+)提出",
    r"中华人民共和国([^\n，,。.]{2,20})",
]
REPLACES_PATTERN = r"(?:替代|代替|本标准替代)(?:标准)?[：:]*\s*((?:GB|DL|NB)[^\n]+)"

# --- fixed values: classification --------------------------------------------------------
DOCUMENT_CATEGORIES = {
    "电气安全": ["插头", "插座", "电气安全", "触电", "绝缘", "接地", "漏电"],
    "插头插座": ["插头", "插座", "连接器", "额定电流", "额定电压"],
    "电力设备": ["变压器", "开关", "断路器", "电力设备", "配电"],
    "电缆": ["电缆", "导线", "线缆", "电线"],
    "防护": ["防护", "防水", "防尘", "IP等级"],
    "测试": ["试验", "测试", "检验", "检测方法"],
}
VOLTAGE_LEVELS = {
    "250V": ["250V", "250伏"],
    "380V": ["380V", "380伏"],
    "10kV": ["10kV", "10千伏"],
    "35kV": ["35kV", "35千伏"],
    "110kV": ["110kV", "110千伏"],
    "220kV": ["220kV", "220千伏"],
}
QUERY_CATEGORIES = {
    "配电": ["配电室", "配电柜", "配电系统", "配电装置", "配电网", "配网", "低压开关柜", "开关柜", "母线", "进线柜", "出线柜"],
    "变电": ["变电站", "变压器", "变电设备", "变电所", "主变", "副变", "变电容量", "变电运行", "变电检修", "油浸式", "干式变压器"],
    "继保": ["继电保护", "保护装置", "保护系统", "整定", "整定计算", "保护配置", "保护定值", "差动保护", "距离保护", "过流保护", "零序保护", "保护原理", "选择性", "灵敏性", "速动性"],
    "输电": ["输电线路", "架空线", "电缆", "输电走廊", "导线", "绝缘子", "杆塔", "输电容量"],
    "安全": ["安全距离", "安全措施", "防护", "接地", "防雷", "安全净距", "防护等级", "IP等级", "接地电阻", "接地装置"],
}
NORMATIVE_WORDS = ["应", "应当", "必须", "不得", "禁止"]
TECHNICAL_WORDS = ["技术要求", "技术参数", "性能指标"]
OPERATION_WORDS = ["操作", "步骤", "方法", "程序"]

# --- fixed values: question preparation --------------------------------------------------
TERM_DICTIONARY = [
    ("PT", "电压互感器"), ("CT", "电流互感器"), ("刀闸", "隔离开关"), ("刀开关", "隔离开关"),
    ("断路器", "断路器"), ("开关柜", "开关柜"), ("10千伏", "10kV"), ("35千伏", "35kV"),
    ("110千伏", "110kV"), ("220千伏", "220kV"), ("十千伏", "10kV"), ("接地", "接地"),
    ("防雷", "防雷"), ("避雷针", "接闪杆"), ("避雷器", "避雷器"), ("配电房", "配电室"),
    ("变压器室", "变压器室"),
]
SYNONYMS = [
    ("要求", ["规定", "标准", "规范"]),
    ("距离", ["间距", "间隔", "间隙"]),
    ("安全", ["防护", "保护"]),
    ("设置", ["安装", "配置", "布置"]),
    ("检测", ["测试", "检验", "试验"]),
]
COMPARISON_PATTERN = "比较|对比|区别|差异|不同|平衡"
MULTI_ASPECT_PATTERN = "分别|各自|和|与|以及|及"
QUESTION_INTENT_PATTERN = "哪些|什么|如何|要求|原则|配置|方式|规定"
COREFERENCE_PATTERN = "它|该|此|这个|上述|上面|前面|之前提到|刚才说的|其中|其(?!他)"
ELLIPSIS_PATTERN = "^(还有|另外|此外|同时|以及|那么|那)(哪些|什么|怎么|如何|是否|有没有)"
VAGUE_WORDS = ["要求", "规定", "标准", "怎么", "如何", "什么", "哪些", "多少", "是否", "能不能"]
SPECIFIC_PATTERNS = [r"[0-9]+kV", r"GB\s*[0-9]+", r"DL/T\s*[0-9]+", r"[0-9]+(?:米|m|毫米|mm)"]
CLEARLY_SPECIFIC_PATTERNS = [
    r"GB[/T]*[/\s]*[0-9]+", r"DL[/T]*[/\s]*[0-9]+", r"NB[/T]*[/\s]*[0-9]+",
    r"N-[0-9]+准则", r"[0-9]+kV", r"[0-9]+\.[0-9]+(?:\.[0-9]+)*",
]
COMPATIBILITY_PATTERNS = [
    "能否.*参照", "是否.*适用", "可以.*参照", "适用.*吗", "适用.*哪些", "包含.*哪些", ".*适用范围",
]
CONTENT_STOP_WORDS = ["的", "是", "什么", "有哪些", "怎么", "如何", "请问", "请", "要求", "规定"]
CONTENT_STANDARD_STRIP = r"GB[/T\s]*[0-9]+[-–][0-9]+|DL[/T\s]*[0-9]+[-–][0-9]+|NB[/T\s]*[0-9]+[-–][0-9]+"
REFERENCE_INDICATORS = [
    "应符合", "须符合", "需符合", "必须符合", "应满足", "须满足", "需满足", "应执行",
    "参见", "参考", "见", "依据", "按照", "根据", "引用", "遵循",
]
GAP_PREFIX_PATTERN = r"^(缺少|未找到|没有|不包含)\s*"
GAP_STANDARD_PATTERN = r"(GB|DL|NB)[/\s]*[T]?\s*[0-9]+[-–—][0-9]+\s*(的)?"
GAP_DEFAULT_NEED = "详细内容"

# --- fixed values: routing ---------------------------------------------------------------
ROUTE_STANDARD = r"GB[/\s]*[T]?\s*[0-9]+|DL[/\s]*T\s*[0-9]+|NB[/\s]*T\s*[0-9]+"
ROUTE_CLAUSE = r"第?\s*[0-9]+(\.[0-9]+)*\s*[条款节章]"
ROUTE_COMPARISON = "对比|差异|区别|比较|不同|相同|平衡|异同"
ROUTE_INVOLVES = (
    "(引用|涉及|包含|提到|参考|依据).{0,5}(哪些|什么).*标准|"
    "(哪些|什么).*标准.{0,5}(引用|涉及|包含|提到|参考|依据)"
)
ROUTE_STANDARD_PAIR = (
    r"(?:GB|DL|NB)[/\s]*[T]?\s*[0-9]+.{0,10}(?:和|与|及).{0,10}"
    r"(?:GB|DL|NB)[/\s]*[T]?\s*[0-9]+.{0,10}(?:区别|不同|差异|对比|比较)"
)
ROUTE_CONSTRAINTS = "(同时|都|均).{0,5}(满足|符合|达到|要求)|既.{1,15}又"

# --- fixed values: retrieval -------------------------------------------------------------
RRF_K = 60
RECALL_LIMITS = {"vector": 20, "keyword": 20, "structured": 10, "visual": 50}
FUSED_LIMIT = 50
RELAXATION_ORDER = ["voltage_level", "category", "doc_type", "standard_no"]
RELAXATION_MIN_HITS = 3
TYPE_BOOST = {"text": 1.0, "table": 1.05, "image_description": 1.08}
TOC_LINE_PATTERN = r"(?m)[一-鿿\p{L}\p{N}_]{2,}\s+[0-9]{1,3}\s*$"
FIGURE_PATTERN = r"图\s*([0-9]+(?:[.\-][0-9]+)*)"
CITATION_PATTERN = r"\[([0-9]+)\]"

# --- fixed values: text quality ----------------------------------------------------------
SCRIPT_RANGES = [
    (0x0400, 0x052F, "Cyrillic"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"),
    (0x0750, 0x077F, "Arabic Supplement"), (0x0780, 0x07BF, "Thaana"), (0x07C0, 0x07FF, "NKo"),
    (0x0800, 0x083F, "Samaritan"), (0x0840, 0x085F, "Mandaic"), (0x0860, 0x086F, "Syriac Supplement"),
    (0x0870, 0x089F, "Arabic Extended-B"), (0x0900, 0x097F, "Devanagari"), (0x0C80, 0x0CFF, "Kannada"),
    (0x1000, 0x109F, "Myanmar"), (0x1100, 0x11FF, "Hangul Jamo"), (0x1200, 0x137F, "Ethiopic"),
    (0x13A0, 0x13FF, "Cherokee"), (0x1400, 0x167F, "Canadian Syllabics"), (0x1800, 0x18AF, "Mongolian"),
    (0x1A20, 0x1AAF, "Tai Tham"), (0x2C00, 0x2C5F, "Glagolitic"), (0xA000, 0xA48F, "Yi"),
]
CJK_RANGES = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2EBEF)]
RARE_CJK_RANGE = (0x7280, 0x72DF)
RARE_CJK_WHITELIST = "犀犁犄犊犒犟犬犯状犷犹狂狄狈狐狗狙狞"
QUALITY = {
    "max_pages": 10, "min_chars_per_page": 50,
    "quality_min_chars": 300, "quality_bad_ratio": 0.03, "map_error_ratio": 0.04,
    "rare_cjk_count": 30, "rare_cjk_ratio": 0.026,
    "punct_run": 4, "punct_min_chars": 100, "punct_ratio": 0.25, "punct_run_ratio": 0.10,
    "script_min_chars": 300, "script_min_cjk": 100, "script_count": 120, "script_ratio": 0.18,
    "script_kinds": 3, "script_dense_chars": 5,
}

# --- fixed values: layout ----------------------------------------------------------------
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st")]
CONTROL_REPLACEMENTS = [("\r\n", ""), ("\u0002", "-")]
LINE_END_HYPHEN_PATTERN = "[A-Za-z]+[-­‐‑⁃]\\s*$"
CONTINUATION_END_MARKERS = [
    "(续)", "(续表)", "(续上表)", "(continued)", "(cont.)", "(cont’d)", "(…continued)", "continued", "续表",
]
CONTINUATION_INLINE_MARKERS = ["(continued)"]
FURNITURE_TYPES = ["header", "footer", "page_number", "aside_text", "page_footnote"]

# --- fixed values: marks that may end a line, marks that may open one ------------------------
LINE_STOPS = [".", "!", "?", "。", "！", "？", ")", "）", '"', "”", ":", "：", ";", "；", "]", "】", "}", ">", "》", "、", ",", "，", "-", "—", "–"]
LINE_STARTS = ["(", "（", '"', "“", "【", "{", "《", "<", "「", "『", "["]
