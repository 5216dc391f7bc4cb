"""Fixed values of the retrieval semantics, and defaults. Word lists are parameters: these are their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Words that mark a query as depending on time, by the step that asks.
TIME_WORDS_RETRIEVAL = ("最新", "当前", "现在", "今年", "最近", "近期", "公告", "通知")
TIME_WORDS_GATE = ("最新", "当前", "现在", "今年", "最近", "近期")
TIME_WORDS_GATEWAY = ("最新", "当前", "现在", "今年", "最近", "近期", "公告", "通知", "今日", "今天")
# Words of the routes.
FOLLOW_UP_WORDS = ("还有", "那", "这个", "它", "呢", "吗")
FAQ_WORDS = ("电话", "地址", "住宿", "学费", "资助", "奖学金", "贷款")
GATEWAY_FOLLOW_UP = ("那", "还", "这个", "那个", "呢", "吗", "再说")
GATEWAY_SMALLTALK = ("你好", "在吗", "谢谢", "哈哈", "hi", "hello")
GATEWAY_PROCESS = ("流程", "步骤", "怎么", "如何", "办理", "报到", "报名", "申请", "提交材料")
GATEWAY_FAQ = ("电话", "地址", "学费", "住宿", "资助", "奖学金", "贷款", "收费")
# Rewriting.
QUESTION_WORDS = ("怎么", "如何", "能不能", "是否", "哪些", "多少")
INTENT_WORDS = ("学费", "住宿费", "住宿", "奖学金", "资助", "贷款", "电话", "地址", "报到", "报名", "录取", "分数线", "转专业", "选科", "学制")
CONSTRAINTS = r"20[0-9]{2}|[0-9]+分|[0-9]+元|不(?:要|能|可以|允许)|河南|河北|艺术类|理工类"
COMPLEX_WORDS = ("对比", "比较", "区别", "同时", "以及", "步骤", "流程", "为什么", "如何", "条件")
# Ingest.
HIGHLIGHTS = ("第", "学费", "资助", "录取", "招生", "电话", "地址", "奖学金", "贷款", "公告")
EXPANSION_RULES = (
    ("学费", ("学费标准", "收费标准")), ("住宿费", ("住宿费标准",)), ("住宿", ("住宿安排",)), ("助学贷款", ("助学贷款", "贷款额度")), ("贷款", ("助学贷款",)),
    ("奖学金", ("奖学金政策",)), ("资助", ("资助政策",)), ("录取", ("录取规则", "录取条件")), ("分数", ("分数要求",)), ("报到", ("报到流程",)),
    ("注册", ("注册流程",)), ("专业", ("专业要求",)), ("选科", ("选科要求",)), ("电话", ("咨询电话",)), ("地址", ("联系地址",)),
)
# Features, their order and what they need.
FEATURE_ORDER = ("rag", "web_search", "skill_exec", "use_saved_skill", "citation_guard")
FEATURE_NEEDS = {"use_saved_skill": "skill_exec", "citation_guard": "rag"}
TOOL_FEATURES = {"search": "web_search", "react": "skill_exec", "plan": "skill_exec", "guide": "skill_exec"}
# Patterns that are cut out of outside text, in order, and what stands for them.
INJECTIONS = (
    (r"(?is)<script.*?>.*?</script>", "[已移除脚本片段]"),
    (r"(?i)ignore\s+previous\s+instructions", "[已清洗潜在注入指令]"),
    (r"(?i)system\s+prompt", "[已清洗潜在注入指令]"),
    (r"(?i)developer\s+message", "[已清洗潜在注入指令]"),
    (r"(?i)you\s+are\s+chatgpt", "[已清洗潜在注入指令]"),
    (r"忽略(之前|以上|前面)的?(所有)?(系统|规则|指令)", "[已清洗潜在注入指令]"),
    (r"输出(系统提示词|提示词|内部指令)", "[已清洗潜在注入指令]"),
)
# Audits of input and output, the first that fits counts.
INPUT_RULES = ((r"(?i)(输出|展示|泄露).*(系统提示词|提示词|内部指令|developer message|system prompt)", "prompt_leak_request"), (r"(?i)(忽略|绕过).*(系统|规则|限制|审计|校验)", "policy_bypass_request"))
OUTPUT_RULES = ((r"(?i)(系统提示词|system prompt|developer message|内部指令)", "prompt_leak_output"), (r"(?i)(api[_\s-]?key|access[_\s-]?token|sk-[a-z0-9]{10,})", "secret_like_output"))


@dataclass(frozen=True)
class Settings:
    chunk: int = 500
    overlap: int = 80
    least_chunk: int = 20
    top_n: int = 40
    top_k: int = 8
    retry_n: int = 64
    rrf_k: int = 60
    sparse_weight: float = 1.0
    dense_weight: float = 1.0
    exact_weight: float = 1.2
    min_sources: int = 2
    min_top_score: float = 0.18
    min_coverage: float = 0.25
    as_of: str = "2024-06-01"
    breaker_failures: int = 2
    breaker_seconds: int = 5
    cache_seconds: int = 300
    summary_chars: int = 600
    max_cases: int = 48

    @property
    def parent(self) -> tuple[int, int]:
        """Size and overlap of parent windows."""
        return max(3 * self.chunk, 1200), min(max(2 * self.overlap, 80), 160)


SETTINGS = Settings()

# Words of a user that say how answers should look, the first that occurs counts, and the preference that each stands for.
STYLE_WORDS = (("简短", "偏好简短回答"), ("简洁", "偏好简短回答"), ("详细", "偏好详细回答"), ("分点", "偏好分点回答"), ("表格", "偏好表格化展示"))
# Features (id, on by default, needs) and tools (id, kind, timeout in seconds, attempts, longest query, for time-sensitive queries only, audit scope).
FEATURES = (("rag", True, ()), ("web_search", False, ()), ("skill_exec", False, ()), ("use_saved_skill", False, ("skill_exec",)), ("citation_guard", True, ("rag",)))
TOOLS = (
    ("local_rag", "local", 1.2, 1, 200, False, "rag"), ("web_search", "remote", 0.8, 1, 120, True, "web_search"), ("web_read", "remote", 1.0, 1, 240, True, "web_read"),
    ("skill_exec", "local", 1.0, 1, 200, False, "skill_exec"), ("saved_skill", "local", 1.0, 1, 200, False, "use_saved_skill"),
)
# Ablation variants.
VARIANTS = (
    "rrf_hybrid_rewrite_off", "rrf_hybrid_rewrite_on", "rrf_hybrid_small2big_off", "rrf_hybrid_small2big_on", "rrf_hybrid_rerank_off", "rrf_hybrid_rerank_on",
    "bm25_only", "dense_only", "exact_only",
)
