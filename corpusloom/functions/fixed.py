"""Lists and patterns that must be exactly these for results to be right."""

from __future__ import annotations

# Abbreviations and what they stand for, applied one after the other in this order.
ABBREVIATIONS = {
    "ko": "không", "k": "không", "kh": "không", "hk": "không", "dc": "được", "đc": "được", "ok": "đồng ý",
    "oke": "đồng ý", "okie": "đồng ý", "vk": "vợ", "ck": "chồng", "ny": "người yêu", "ngy": "người yêu",
    "bff": "bạn thân", "bb": "bạn bè", "m": "mình", "mik": "mình", "mịk": "mình", "t": "tôi", "toi": "tôi",
    "tớ": "tôi", "bn": "bạn", "bno": "bạn", "bạn": "bạn", "ae": "anh em", "cj": "chị", "a": "anh", "e": "em",
    "crush": "người thầm thích", "nyc": "người yêu cũ", "bae": "người yêu", "bồ": "người yêu", "hnay": "hôm nay",
    "hqua": "hôm qua", "mai": "ngày mai", "cn": "chủ nhật", "t2": "thứ hai", "t3": "thứ ba", "t4": "thứ tư",
    "t5": "thứ năm", "t6": "thứ sáu", "t7": "thứ bảy", "hn": "hôm nay", "mai n": "ngày mai", "trc": "trước",
    "trước đó": "trước", "sau n": "sau này", "nay": "hôm nay", "nãy": "lúc nãy", "vs": "với", "vsz": "với",
    "w": "với", "wa": "quá", "wá": "quá", "qá": "quá", "qa": "quá", "zui": "vui", "hpx": "hạnh phúc",
    "hp": "hạnh phúc", "hpny": "happy new year", "bùn": "buồn", "sad": "buồn", "sr": "xin lỗi", "thk": "cảm ơn",
    "tks": "cảm ơn", "thanks": "cảm ơn", "ty": "cảm ơn", "thx": "cảm ơn", "bt": "bình thường", "thjk": "thích",
    "thik": "thích", "huhu": "(khóc)", "hic": "(thở dài)", "haizz": "(thở dài)", "haiz": "(thở dài)",
    "kaka": "(cười)", "hehe": "(cười)", "hihi": "(cười)", "kkk": "(cười)", "kk": "(cười)", "zz": "(chán)",
    "zzz": "(buồn ngủ)", "g9": "chúc ngủ ngon", "gn": "chúc ngủ ngon", "gm": "chào buổi sáng", "max": "rất",
    "siêu": "rất", "vđ": "vãi", "vđk": "vãi", "xịn": "tốt", "xịn sò": "tốt", "dth": "dễ thương", "dthw": "dễ thương",
    "mn": "mọi người", "ms": "mới", "r": "rồi", "òi": "rồi", "oy": "rồi", "rùi": "rồi", "j": "gì", "ji": "gì",
    "z": "gì", "cg": "cũng", "chx": "chưa", "nch": "nói chung", "qtqđ": "quá trời quá đất", "vl": "vãi", "vcl": "vãi",
    "vlcl": "vãi", "vkl": "vãi", "lm": "làm", "lj": "lý do", "nge": "nghe", "ngek": "nghe", "nx": "nhận xét",
    "kq": "kết quả", "nv": "như vậy", "ntna": "như thế nào", "hum": "hôm", "humk": "hôm", "ib": "inbox",
    "inb": "inbox", "inbox": "inbox", "rep": "trả lời", "rv": "review", "má ơi": "trời ơi", "má": "mẹ",
    "lol": "cười lớn", "lmao": "cười lăn lộn", "omfg": "trời ơi", "wtf": "cái gì vậy", "dm": "chết tiệt",
    "đm": "chết tiệt", "cc": "", "cl": "", "ad": "admin", "acc": "tài khoản", "add": "thêm", "fb": "facebook",
    "tt": "tiktok", "yt": "youtube", "sg": "sài gòn", "dn": "đà nẵng", "q1": "quận 1", "q3": "quận 3", "q7": "quận 7",
    "pls": "làm ơn", "plz": "làm ơn", "idk": "không biết", "imo": "theo ý tôi", "imho": "theo ý tôi",
    "tbh": "thật lòng mà nói", "brb": "quay lại ngay", "btw": "nhân tiện", "aka": "còn gọi là",
    "asap": "càng sớm càng tốt", "fyi": "để bạn biết", "np": "không sao", "u": "bạn", "ur": "của bạn",
    "fs": "free ship", "freeship": "free ship", "sale off": "giảm giá", "km": "khuyến mãi",
    "kmđb": "khuyến mãi đặc biệt", "ib deal": "inbox thương lượng", "deal": "thương lượng", "tl": "tài liệu",
    "tg": "tác giả", "sv": "sinh viên", "cv": "hồ sơ", "jd": "mô tả công việc", "hr": "nhân sự", "bk": "bách khoa",
    "cntt": "công nghệ thông tin", "clgt": "cái quái gì thế", "sml": "xỉu luôn", "toang": "hỏng bét",
    "toang rồi": "hỏng bét",
}

# What duplicate normalisation removes.
URL = r"(?:https?://\S+|www\.\S+|\bhttps?\b\s*(?:[:/._-]\s*|\s+)[a-z0-9][a-z0-9\s._/-]{2,})"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b"
MENTION = r"(?<!\w)@[\w_.-]+"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"

# Characters that the legacy cleaner drops.
EMOJI = "[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f1e0-\U0001f1ff\U00002702-\U000027b0\U000024c2-\U0001f251]+"

# Topic tokens that are numbers, and left-overs of addresses.
PURE_NUMBER = r"^[+-]?(?:\d+(?:[.,]\d+)*)$"
WEB_RESIDUE = ["http", "https", "www", "com"]

# Annotation topics; T00 is the fallback and takes no secondary topic.
FALLBACK_TOPIC = "T00"
TOPICS = [f"T{i:02d}" for i in range(13)]
NO_SECONDARY = "NONE"

# Sizes and thresholds of the analyses.
THRESHOLDS = (0.90, 0.95, 0.98)
MIN_CHARS = 30
FAMILY_THRESHOLD = 0.95
NEIGHBOURS = 25
TOLERANCE = 1e-8
NO_BELOW, NO_ABOVE = 5, 0.40
TOP_TERMS, DIVERSITY_TERMS, REPRESENTATIVES, AMBIGUOUS = 15, 10, 10, 100
MAX_DOMINANT_SHARE = 0.70
MATCH_RATIOS = (1.10, 1.25, 1.50)
