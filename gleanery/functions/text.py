"""Column functions over text: tokens, identifiers, overlap, keys and bands. All stay inside Spark's own expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"


#: Words that say nothing about a request. Fixed values.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "cannot", "component", "could", "did", "do",
    "does", "for", "from", "generated", "had", "has", "have", "if", "in", "into", "is", "it", "its", "may", "not", "of",
    "on", "or", "page", "pages", "should", "that", "the", "their", "then", "this", "to", "was", "were", "when", "where",
    "which", "while", "with", "would",
)
#: Triggers in a request and the terms that they add. Fixed values.
EXPANSIONS = (
    (("跳转", "路由", "导航", "打开页面", "页面跳", "白屏", "空白页", "打不开"), ("route", "routes", "router", "pushurl", "replaceurl", "navigation", "page", "pages", "pagestack")),
    (("资源", "图片", "图标", "文案", "字符串", "显示不出来", "不显示", "找不到资源"), ("resource", "resources", "media", "image", "string", "app.media", "app.string", "$r")),
    (("日志", "报错", "错误", "异常", "失败", "崩溃", "打印", "定位"), ("log", "logger", "console", "hilog", "error", "warning", "exception", "failed", "failure", "debug")),
    (("加载", "请求", "接口", "网络", "用户", "资料", "数据"), ("load", "request", "fetch", "network", "profile", "account", "user", "data")),
    (("权限", "授权", "网络权限", "依赖", "配置", "ability", "module"), ("permission", "permissions", "dependency", "dependencies", "ability", "module", "json5", "config")),
    (("鸿蒙", "harmony", "harmonyos", "arkts", "ets"), ("harmonyos", "arkts", "ets", "entry", "ability", "stage")),
    (("separator", "分隔线", "分割线"), ("divider", "strokewidth", "separator")),
)
#: Parts of paths that are too common to identify a file. Fixed values.
GENERIC_PATH_TERMS = ("common", "content", "detail", "item", "main", "media", "service", "services", "src", "utils", "utility", "view", "views")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U)[\\w{CJK}]+"), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case; a sharp s counts as two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """Case-folded words in order."""
    return _words(folded(text))


def pieces(w: Column) -> Column:
    """A word, and its two-character pieces if it has CJK characters."""
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    return F.when(w.rlike(f"[{CJK}]") & (F.length(w) > 1), F.concat(F.array(w), two)).otherwise(F.array(w))


def tokens(text: Column) -> Column:
    """Case-folded word tokens in order; a token with CJK characters is followed by its two-character pieces."""
    return F.flatten(F.transform(words(text), pieces))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    low = folded(text)
    cjk = F.regexp_extract_all(low, F.lit(f"(?U)[\\w{CJK}]*[{CJK}][\\w{CJK}]*"), F.lit(0))
    more = F.when(low.rlike(f"[{CJK}]"), F.aggregate(cjk, F.lit(0), lambda n, w: n + F.length(w) - 1)).otherwise(0)
    return F.regexp_count(low, F.lit(f"(?U)[\\w{CJK}]+")) + more


def _nothing() -> Column:
    return F.array().cast("array<string>")


def identifier_parts(name: Column) -> Column:
    """The parts of an identifier, split at acronyms, camel case and separators, but for one that is the whole name."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.transform(F.split(spaced, r"(?U)[_\W]+"), folded)
    return F.filter(parts, lambda p: (F.length(p) > 0) & (p != folded(name)))


def singulars(word: Column) -> Column:
    """A list of a word's singular, if it looks like a plural of ASCII letters."""
    plain = word.rlike("^[A-Za-z]{4,}$")
    long_y = plain & word.rlike("(ies|ied)$") & (F.length(word) > 4)
    ending = plain & word.rlike("s$") & ~word.rlike("(ss|us|is)$")
    return F.when(long_y, F.array(F.concat(F.regexp_replace(word, "(ies|ied)$", ""), F.lit("y")))).when(ending, F.array(F.regexp_replace(word, "s$", ""))).otherwise(_nothing())


def singular(word: Column) -> Column:
    """A word without its plural ending."""
    return F.coalesce(F.try_element_at(singulars(word), F.lit(1)), word)


def significant(token: Column) -> Column:
    """Whether a token tells anything: no stop word, and more than one ASCII character."""
    return ~token.isin(*STOPWORDS) & ((F.length(token) > 1) | token.rlike("[^\\x00-\\x7F]"))


def query_tokens(query: Column) -> Column:
    """Distinct terms of a request, in order: tokens, parts of identifiers, singulars of both, and what triggers add."""
    told = F.filter(F.concat(tokens(query), F.flatten(F.transform(_words(query), identifier_parts))), significant)
    low = F.lower(query)
    added = [F.when(reduce(lambda x, y: x | y, (low.contains(t) for t in triggers)), F.array(*map(F.lit, terms))).otherwise(_nothing()) for triggers, terms in EXPANSIONS]
    return F.array_distinct(F.concat(told, F.flatten(F.transform(told, singulars)), *added))


def bounded_tokens(query: Column, most: int) -> Column:
    """At most so many terms: the first half in order, then plain ones before others and longer before shorter."""
    every = query_tokens(query)
    head = F.slice(every, 1, max(1, most // 2))
    rest = F.transform(F.slice(every, max(1, most // 2) + 1, 1 << 20), lambda t, i: F.struct((~t.rlike("^[A-Za-z0-9]+$")).cast("int").alias("odd"), (-F.length(t)).alias("short"), i.alias("i"), t.alias("t")))
    return F.concat(head, F.transform(F.slice(F.array_sort(rest), 1, most - max(1, most // 2)), lambda x: x["t"]))


def method_variants(token: Column) -> Column:
    """A token, its singular, and its stem without -ing or -ed."""
    ing, ed = F.regexp_replace(token, "ing$", ""), F.regexp_replace(token, "ed$", "")
    stem_ing = F.when(ing.rlike(r"^.{2,}(.)\1$"), F.regexp_replace(ing, ".$", "")).otherwise(ing)
    stem_ed = F.when(ed.endswith("i"), F.regexp_replace(ed, "i$", "y")).otherwise(ed)
    stem = F.when(token.endswith("ing") & (F.length(token) > 6), F.array(stem_ing)).when(token.endswith("ed") & (F.length(token) > 5), F.array(stem_ed)).otherwise(_nothing())
    return F.array_distinct(F.concat(F.array(token), singulars(token), stem))


def json_or_csv(text: Column) -> Column:
    """The entries of a JSON list, or those between commas; blank ones fall away."""
    listed = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    parts = F.when(listed.isNotNull(), listed).otherwise(F.transform(F.split(F.trim(text), ","), lambda v: F.trim(v)))
    return F.filter(F.coalesce(parts, _nothing()), lambda v: F.length(F.trim(v)) > 0)


def token_matches(token: Column, lowered: Column) -> Column:
    """Whether a text holds a token; short plain ones only as a word."""
    word = F.regexp_like(lowered, F.concat(F.lit("(?<![a-z0-9])"), token, F.lit("(?![a-z0-9])")))
    return F.when(token.rlike("^[A-Za-z0-9]{1,3}$"), word).otherwise(lowered.contains(token))


def path_terms(path: Column) -> Column:
    """The distinct parts of a path that may identify it."""
    return F.filter(F.array_distinct(F.split(F.lower(path), "[^a-z0-9]+")), lambda p: (F.length(p) > 0) & ~p.isin(*GENERIC_PATH_TERMS))


def canonical(text: Column) -> Column:
    """Case-folded words, one space between."""
    return F.trim(F.regexp_replace(folded(text), f"(?U)[^\\w{CJK}]+", " "))


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether canonical text holds a canonical phrase as whole words."""
    return (F.length(phrase) > 0) & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


#: What stands for values in a message template. Fixed value.
PLACEHOLDER = r"\$\{[^{}]*\}|%\{(?:public|private)\}[A-Za-z]|%[-+0-9.#]*[A-Za-z]|\{[A-Za-z_][\w.]*\}"


def literal_segments(template: Column) -> Column:
    """What a message template says between its placeholders."""
    return F.filter(F.transform(F.split(template, PLACEHOLDER), canonical), lambda x: F.length(x) > 0)


def template_fingerprint(level: Column, logger: Column, template: Column, owner: Column) -> Column:
    """A key of 16 hexadecimal digits of the event that a log statement reports."""
    skeleton = canonical(F.regexp_replace(template, PLACEHOLDER, " <value> "))
    return F.substring(F.sha2(F.concat_ws("|", F.lower(level), F.lower(logger), skeleton, owner), 256), 1, 16)


def layer(path: Column) -> Column:
    """The layer that a path tells of; the first rule that fits."""
    low = F.lower(path)
    has = lambda *terms: reduce(lambda x, y: x | y, (low.contains(t) for t in terms))
    return (
        F.when(has("test", "spec"), "test")
        .when(low.rlike(r"\.(json|json5|yaml|yml|toml)$") | has("config"), "config")
        .when(has("page", "view", "component", "/ui/"), "ui")
        .when(has("repository", "storage", "database", "cache", "/data/"), "data")
        .when(has("viewmodel", "/state/", "/store/"), "state")
        .when(has("service", "client", "/api/"), "service")
        .otherwise("core")
    )


def artifact_role(path: Column) -> Column:
    """test by folder or by the ending of the name, else production."""
    return F.when(path.rlike(r"(?i)(^|/)(__tests__|specs?|tests?)/") | path.rlike(r"(?i)([._-](spec|test)|(Spec|Test))(\.[^./]*)?$"), "test").otherwise("production")


def artifact_family(path: Column) -> Column:
    """What a file and its test have in common: the bare name without a test ending."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(stem, r"(?i)([._-](spec|test)|(spec|test))$", "")), "[^a-z0-9]", "")


#: Words that tell what a request is after; the first rule with a word in it wins. Fixed values.
INTENTS = (
    ("semantic_correction", ("误导", "错误经验", "纠错", "冲突", "不要", "避免", "correction", "wrong", "misleading")),
    ("code_business_semantics", ("what does", "业务语义", "业务含义", "语义", "semantic", "business meaning", "business_summary", "business_terms", "补充")),
    ("memory_maintenance", ("maintain", "治理", "维护", "淘汰", "刷新", "合并", "stale", "archive", "refresh")),
    ("runtime_log_diagnosis", ("日志", "报错", "错误", "异常", "失败", "崩溃", "incident", "log", "traceback", "exception", "error", "failed", "failure")),
    ("procedure_reuse", ("如何", "怎么", "步骤", "流程", "方案", "procedure", "playbook", "workflow", "how to")),
    ("code_location", ("代码", "函数", "文件", "调用", "当前", "source", "code", "function", "file", "在哪里", "位置", "path")),
)
#: Words of each goal. Fixed values.
GOALS = (
    ("design", ("设计", "方案", "重构", "模块划分", "接口设计", "状态流", "扩展点", "design", "refactor", "proposal", "tradeoff")),
    ("change_impact", ("影响", "改动", "修改", "变更", "diff", "change", "impact", "回归", "测试范围")),
    ("diagnosis", ("报错", "错误", "异常", "失败", "日志", "崩溃", "空白", "卡死", "定位", "原因", "事故", "debug", "error", "fail", "incident", "diagnos", "log")),
    ("governance", ("治理", "维护", "淘汰", "冲突", "过期", "质量", "合并", "归档", "stale", "governance")),
    ("experience_reuse", ("经验", "以前", "历史", "曾经", "复用", "教训", "规律", "experience", "lesson", "past")),
)


def intent(query: Column) -> Column:
    """What a request is after, by the first rule with a word in it."""
    low = F.lower(query)
    return F.coalesce(*(F.when(reduce(lambda x, y: x | y, (low.contains(w) for w in words)), name) for name, words in INTENTS), F.lit("general_context"))


def goal(query: Column) -> Column:
    """The goal with the most words in a request; of equals the first, and without any code_understanding."""
    low = F.lower(query)
    hits = [(name, reduce(lambda x, y: x + y, (low.contains(w).cast("int") for w in words))) for name, words in GOALS]
    most = F.greatest(*(n for _, n in hits))
    return F.coalesce(*(F.when((n == most) & (n > 0), name) for name, n in hits), F.lit("code_understanding"))


def key_values(text: Column) -> Column:
    """A map of the key=value pairs of a log line; of equal keys the last counts."""
    keys = r"(route|resource|request_id|session_id|trace_id|span_id|parent_span_id|trace_flags|event_name|service\.name|service\.version|span_kind|duration_ms|code|error_code|reason|result|page|module|ability)"
    pairs = F.regexp_extract_all(text, F.lit(rf"\b{keys}=([^\s]+)"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_replace(F.split(p, "=", 2)[0], "^code$", "error_code").alias("key"), F.split(p, "=", 2)[1].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, 1 << 20), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def event_type(message: Column, fields: Column) -> Column:
    """The kind of event that a message reports; the first rule that fits."""
    low = F.lower(message)
    return (
        F.when(low.contains("session invalid"), "session_invalid")
        .when(low.contains("permission denied"), "permission_denied")
        .when(low.contains("load profile start"), "profile_load_started")
        .when(low.contains("load profile failed"), "profile_load_failed")
        .when(low.contains("navigate") & F.try_element_at(fields, F.lit("route")).isNotNull(), "route_navigation")
        .when(message.rlike("/[A-Za-z0-9_./-]+"), "network_request")
        .otherwise("generic_runtime_event")
    )


def unique_list(values: Column) -> Column:
    """Trimmed, lower-case, distinct values in order of first occurrence, without empty ones."""
    return F.filter(F.array_distinct(F.transform(values, lambda v: F.lower(F.trim(v)))), lambda v: F.length(v) > 0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct elements over all distinct elements; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def normal_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "(^-+|-+$)", "")


def event_key(*parts: Column) -> Column:
    """A stable key of 32 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("\n", *(p.cast("string") for p in parts)), 256), 1, 32)


def score_band(score: Column) -> Column:
    """excellent from .8, good from .65, fair from .45, weak below."""
    return F.when(score >= 0.8, "excellent").when(score >= 0.65, "good").when(score >= 0.45, "fair").otherwise("weak")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def present(value: Column) -> Column:
    """Whether a value is neither null, blank, an empty list nor an empty map."""
    return F.coalesce(~F.trim(value.cast("string")).isin("", "[]", "{}"), F.lit(False))


def digest_of(values: dict[str, Column]) -> Column:
    """SHA-256 of values as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values)))), 256)


def positive_query(query: str) -> tuple[list[str], list[str]]:
    """The words of a request that it asks for, and those that it excludes by a clause with "not", "without" or "exclude"."""
    asked, excluded = [], []
    for clause in re.split(r"[,.;]", query.lower()):
        head, told, rest = re.match(r"(.*?)(?:\b(not|without|except|exclude|excluding)\b(.*))?$", clause).groups()
        asked += [w for w in re.findall(r"\w+", head) if w not in STOPWORDS]
        excluded += [w for w in re.findall(r"\w+", rest or "") if told and w not in STOPWORDS]
    return asked, [w for w in excluded if w not in asked]


def in_order(path: Column, wanted: list[str]) -> Column:
    """Whether an array holds the given values in this order, with others between."""
    reached = F.aggregate(path, F.lit(0), lambda at, x: F.when(x == F.try_element_at(F.array(*map(F.lit, wanted)), at + 1), at + 1).otherwise(at))
    return reached == len(wanted)


#: Words of domains; the first domain with a word in a text counts. Fixed values.
DOMAINS = (("navigation", ("navigate", "route", "router")), ("session", ("session", "login", "permission")), ("data", ("profile", "load", "database")), ("network", ("/api/", "http", "request")))


def domain(text: Column) -> Column:
    """What an incident is about, by the first domain with a word in its text."""
    low = F.lower(text)
    return F.coalesce(*(F.when(reduce(lambda x, y: x | y, (low.contains(w) for w in words)), name) for name, words in DOMAINS), F.lit("general"))


#: Words that tell of a failure. Fixed values.
DIAGNOSTIC = ("abort", "crash", "denied", "errno", "error", "exception", "fail", "failed", "failure", "fatal", "panic", "timeout", "unavailable")


def salient(query: Column, most: int = 12) -> Column:
    """The terms that matter most in a request: literals in backticks and their parts, the last six telling words, and what
    stands beside a word of failure."""
    literals = F.regexp_extract_all(query, F.lit("`([^`\\n]{2,240})`"), F.lit(1))
    quoted = F.flatten(F.transform(literals, lambda x: F.concat(tokens(x), F.flatten(F.transform(_words(x), identifier_parts)))))
    raw = tokens(query)
    told = F.filter(raw, lambda t: ~t.isin(*STOPWORDS) & ~t.isin("control", "controls", "locate", "which") & (F.length(t) > 2))
    last = F.slice(told, F.greatest(F.lit(1), F.size(told) - 5), 6)
    beside = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: raw[i].isin(*DIAGNOSTIC)), lambda i: F.slice(raw, F.greatest(F.lit(1), i - 1), F.lit(3) + F.least(i, F.lit(2)))))
    return F.slice(F.filter(F.array_distinct(F.concat(quoted, last, beside)), lambda t: F.length(t) > 1), 1, most)


#: Words that name a kind of owner in a request. Fixed values.
OWNER_KINDS = {
    "adapter": ("adapter", "适配"), "boundary": ("boundary", "边界"), "policy": ("policy", "策略"), "coordinator": ("coordinator", "协调器"),
    "component": ("component", "view", "page", "builder", "组件", "视图", "页面", "构建器"), "controller": ("controller", "控制器"), "manager": ("manager", "管理器"),
    "model": ("model", "模型"), "repository": ("repository", "仓库"), "service": ("service", "服务"), "store": ("store", "状态仓"), "viewmodel": ("viewmodel", "view model", "视图模型"),
}
#: What leads to the target of a request, what ends it, and what tells of several targets. Fixed values.
TARGET_CUE = r"(?i)(?:\b(?:locate|find|identify|return)\b|定位|查找|找到|返回|给出)([^.!?。！？;；\n]*)"
SEVERAL_TARGETS = r"(?i)\b(both|chain|flow|path|trace|owners|and the)\b|链|路径|同时|两个|两处|多个|各自"
#: Words that ask for tests, and for what they test. Fixed values.
VALIDATION = ("assert", "assertion", "coverage", "regression", "spec", "test", "tests", "verify", "verification", "断言", "测试", "验证")
IMPLEMENTATION = ("code", "implementation", "inspect", "locate", "production", "source", "实现", "定位", "方法", "源码", "生产")
#: Concepts of behaviour: groups of words of which all must stand in a request, and the markers that they stand for. A
#: project gives its own; these are a few common ones.
BEHAVIOURS = (
    ((("state", "update"), ("state", "write")), ("state_write", "setstate")),
    ((("route",), ("navigate",)), ("navigation", "router", "pushurl")),
    ((("save", "store"), ("persist",)), ("persistence_write", "storage")),
    ((("early", "return"), ("guard",)), ("guard", "return")),
    ((("list", "empty"),), ("emptystate", "foreach")),
    ((("read", "storage"), ("restore",)), ("persistenceread",)),
    ((("bind", "callback"),), ("uicallbackbinding",)),
)


def _kinds_in(clause: Column) -> list[Column]:
    spaced = F.translate(F.lower(clause), "-_", "  ")
    return [F.when(reduce(lambda x, y: x | y, (spaced.rlike(rf"\b{w}\b") if w.isascii() else spaced.contains(w) for w in words)), kind) for kind, words in OWNER_KINDS.items()]


def _told_targets(query: Column) -> Column:
    return F.array_compact(F.array(*_kinds_in(F.concat_ws(".", F.regexp_extract_all(query, F.lit(TARGET_CUE), F.lit(1))))))


def requested_kinds(query: Column) -> Column:
    """The kinds of owner that a request is after: those of its target, if it names one, else all that it mentions."""
    told = _told_targets(query)
    return F.when(F.size(told) > 0, told).otherwise(F.array_compact(F.array(*_kinds_in(query))))


def target_kinds(query: Column) -> Column:
    """The kinds of owner that a request of one target names as its target."""
    return F.when(query.rlike(SEVERAL_TARGETS), _nothing()).otherwise(_told_targets(query))


def artifact_intent(terms: Column) -> Column:
    """Whether a request of these terms is after tests (validation), both (neutral), or neither or production code (implementation)."""
    has = lambda words: F.arrays_overlap(terms, F.array(*map(F.lit, words)))
    return F.when(has(VALIDATION), F.when(has(IMPLEMENTATION), "neutral").otherwise("validation")).otherwise("implementation")


def owner_named(query: Column, owner: Column) -> Column:
    """Whether a request holds an owner's name of two parts or more as a word of its own."""
    name = F.trim(F.coalesce(owner, F.lit("")))
    parts = F.regexp_extract_all(name, F.lit("[A-Z]+(?=[A-Z][a-z]|$)|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    words = F.regexp_extract_all(F.lower(query), F.lit(r"(?<![-a-z0-9_$/.])[a-z_$][a-z0-9_$]*(?![-a-z0-9_$/.])"), F.lit(0))
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9_$]", "")
    return (F.length(name) >= 3) & (F.size(parts) >= 2) & (plain != "") & F.array_contains(words, plain)


def behaviours(query: Column, terms: Column, concepts: tuple = BEHAVIOURS) -> Column:
    """The markers of the behaviours that a request of these terms describes, its words in any of their forms."""
    low = F.lower(query)

    def told(word: str) -> Column:
        if not (word.isascii() and word.isalnum()):
            return low.contains(word)
        return F.arrays_overlap(terms, F.array(*map(F.lit, (word, f"{word}s", f"{word}ed", f"{word}ing", f"{word}{word[-1]}ing"))))

    every = lambda group: reduce(lambda x, y: x & y, map(told, group))
    found = [F.when(reduce(lambda x, y: x | y, map(every, groups)), F.array(*map(F.lit, markers))).otherwise(_nothing()) for groups, markers in concepts]
    return F.array_distinct(F.concat(*found))



#: Strings and comments of program text.
_MASKED = r"""(?s)"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/"""


def argument_count(call: Column) -> Column:
    """How many arguments stand between the first bracket of a call or signature and the one that closes it; null if none does.

    Commas in strings, comments and inner brackets do not count.
    """
    plain = F.regexp_replace(call, _MASKED, "_")
    chars = F.split(F.regexp_extract(plain, r"(?s)\((.*)$", 1), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas"), F.lit(False).alias("told"), F.lit(False).alias("done"))

    def step(a: Column, c: Column) -> Column:
        opens, closes = c.isin("(", "[", "{"), c.isin(")", "]", "}")
        ends = (c == ")") & (a["depth"] == 0)
        depth = F.when(opens, a["depth"] + 1).when(closes & (a["depth"] > 0), a["depth"] - 1).otherwise(a["depth"])
        more = F.struct(depth.alias("depth"), (a["commas"] + ((c == ",") & (a["depth"] == 0)).cast("int")).alias("commas"), (a["told"] | ~c.rlike(r"\s")).alias("told"), F.lit(False).alias("done"))
        return F.when(a["done"], a).when(ends, F.struct(a["depth"].alias("depth"), a["commas"].alias("commas"), a["told"].alias("told"), F.lit(True).alias("done"))).otherwise(more)

    found = F.aggregate(chars, start, step)
    return F.when(found["done"], F.when(found["told"], found["commas"] + 1).otherwise(0))
