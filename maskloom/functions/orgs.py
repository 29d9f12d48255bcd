"""Organizations by rule: full names by their legal form, aliases that are declared or peeled off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms and kinds that end an organization's full name, the longer first.
FORMS = (
    "股份有限公司", "有限责任公司", "集团有限公司", "有限合伙企业", "合伙企业（有限合伙）", "会计师事务所", "律师事务所", "税务师事务所", "资产评估事务所", "有限公司", "合伙企业",
    "事务所", "研究院", "研究所", "设计院", "基金会", "委员会", "管理局", "交易所", "信用社", "银行", "集团", "协会", "学会", "大学", "医院",
)
#: Words before a name that are no part of it.
LEADS = ("关于", "根据", "由于", "对于", "以及", "收购", "转让", "投资", "控股", "委托", "聘请", "通过", "按照", "其中", "包括", "拟", "对", "与", "和", "由", "向", "经", "为", "在", "及", "将", "被", "从", "至")
#: Words that peeling takes off the end of a company's name.
INDUSTRIES = ("新能源", "科技", "技术", "贸易", "实业", "投资", "控股", "电子", "信息", "网络", "工程", "建设", "建筑", "材料", "食品", "药业", "能源", "化工", "机械", "物流", "传媒", "文化", "管理", "咨询", "服务", "发展")
#: Places that may stand first in a name; users add theirs by ``Options.more_places``.
PLACES = (
    "北京", "上海", "天津", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "海南",
    "四川", "贵州", "云南", "陕西", "甘肃", "青海", "台湾", "内蒙古", "广西", "西藏", "宁夏", "新疆", "香港", "澳门",
    "广州", "深圳", "杭州", "南京", "成都", "武汉", "苏州", "西安", "长沙", "青岛", "大连", "厦门", "宁波",
)
#: Characters that begin or end no alias.
FUNCTION_WORDS = ("的", "了", "和", "与", "及", "或", "在", "由", "对", "将", "被", "于", "等", "为", "是", "其", "该", "本", "以", "从", "向")
#: Words that name an organization in general, so are no alias of one.
GENERAL = ("公司", "本公司", "该公司", "集团", "企业", "银行", "机构", "单位", "部门", "子公司", "分公司", "母公司", "股东", "客户", "供应商")

_NAME = r"[\x{4e00}-\x{9fa5}A-Za-z0-9_（）()]"
FULL = rf"{_NAME}{{2,30}}?(?:{'|'.join(FORMS)})"
DECLARED = r"[（(]以下(?:简称|称)(?:为)?[:：]?[“\"‘']?([^”\"’'）)]{1,20})[”\"’']?[）)]"


def cleaned(name: Column) -> Column:
    """Without up to five leading words that are no part of a name."""
    return F.regexp_replace(name, f"^(?:{'|'.join(LEADS)}){{1,5}}", "")


def unbracketed(name: Column) -> Column:
    return F.regexp_replace(name, r"（[^（）]*）|\([^()]*\)", "")


def short_of_form(name: Column) -> Column:
    """Without legal form and place marks (省, 市, 县, 区 after a place)."""
    return F.regexp_replace(F.regexp_replace(unbracketed(name), f"(?:{'|'.join(FORMS)})$", ""), r"^([\x{4e00}-\x{9fa5}]{2,3})(?:省|市|县|区)", "$1")


def peeled(name: Column, industries: tuple[str, ...] = INDUSTRIES) -> Column:
    """What is left without form, place marks and, for companies and partnerships, industry words at the end, one or more."""
    base = short_of_form(name)
    if not industries:
        return base
    return F.when(F.rlike(name, F.lit("(公司|合伙企业(（有限合伙）)?)$")), F.regexp_replace(base, f"(?:{'|'.join(industries)})+$", "")).otherwise(base)


def unplaced(name: Column, more: tuple[str, ...] = ()) -> Column:
    """A name without the place it begins with, the longest that fits; one that is a place as a whole stays."""
    places = "|".join(sorted({*PLACES, *more}, key=lambda p: (-len(p), p)))
    return F.regexp_replace(name, rf"^(?:{places})(?:省|市|县|区)?(?=.)", "")


def alias_like(name: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a candidate may be an alias: 2 to 8 characters (4 at least if it ends with a legal form), no place, no general
    word, and no function word at its ends. False for null."""
    edge = "|".join(FUNCTION_WORDS)
    form = F.rlike(name, F.lit(f"(?:{'|'.join(FORMS)})$"))
    ok = F.length(name).between(2, 8) & (~form | (F.length(name) >= 4)) & ~name.isin(*PLACES, *more, *GENERAL) & ~F.rlike(name, F.lit(f"^(?:{edge})|(?:{edge})$"))
    return F.coalesce(ok, F.lit(False))


def full_names(text: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FULL), F.lit(0)), cleaned)), lambda n: F.length(n) >= 4)


def declared(text: Column) -> Column:
    """(full, alias) of each declaration that directly follows a full name; without one before it no alias is bound."""
    both = F.regexp_extract_all(text, F.lit(rf"{FULL}{DECLARED}"), F.lit(0))
    pairs = F.transform(both, lambda b: F.struct(cleaned(F.regexp_extract(b, rf"^(.*?){DECLARED}$", 1)).alias("full"), F.regexp_extract(b, rf"^.*?{DECLARED}$", 1).alias("alias")))
    return F.array_distinct(F.filter(pairs, lambda p: (F.length(p["full"]) >= 4) & (p["alias"] != "")))
