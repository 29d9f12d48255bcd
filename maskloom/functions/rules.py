"""Fixed-format rules: what is looked for in every text, and how dates and amounts are made coarse.

Each rule is a pattern, bounded by digits' absence where it is a number, and a check of what it found. Labels, second digits
of mobiles, the length of cards and the shape of plates are choices of this library.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: an expression inside a lambda is worked out again for each element, and one named twice twice."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


class Rule(NamedTuple):
    name: str
    label: str
    pattern: str
    group: int  # of the pattern, that is the hit
    prio: int  # lower wins among overlapping hits
    needs: str = ""  # a cheap pattern that every text with a hit has; most texts end there


#: provinces' one-character marks of licence plates.
PLATE_MARKS = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼"

EMAIL = Rule("email", "邮箱", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, 10, r"@")
INTL_PHONE = Rule("intl_phone", "电话", r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{4}(?![0-9])", 0, 20, r"[+][0-9]")
ID_CARD = Rule("id_card", "证件", r"(?<![0-9])[0-9]{6}[ -]?[0-9]{8}[ -]?[0-9]{3}[0-9Xx](?![0-9Xx])", 0, 30, r"[0-9]{6}")
CREDIT_CODE = Rule("credit_code", "信用代码", r"(?<![0-9A-Z])[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}(?![0-9A-Z])", 0, 35, r"[0-9]{6}")
CARD = Rule("card", "账号", r"(?<![0-9])[0-9]{16,19}(?![0-9])", 0, 40, r"[0-9]{16}")
MOBILE = Rule("cn_mobile", "电话", r"(?<![0-9])1[0-9]{10}(?![0-9])", 0, 50, r"[0-9]{11}")
LANDLINE = Rule("landline", "电话", r"(?<![0-9])0[0-9]{2,3}-[0-9]{7,8}(?:-[0-9]{1,6})?(?![0-9])", 0, 55, r"[0-9]-[0-9]{7}")
IPV4 = Rule("ipv4", "IP", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])", 0, 60, r"[0-9][.][0-9]")
MAC = Rule("mac", "MAC", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f])", 0, 65, r"[0-9A-Fa-f][:-][0-9A-Fa-f]{2}[:-]")
PLATE = Rule("plate", "车牌", rf"[{PLATE_MARKS}][A-Za-z][·. -]?(?=[A-Za-z]{{0,5}}[0-9])[A-Za-z0-9]{{5,6}}(?![A-Za-z0-9_])", 0, 70, r"[\x{4e00}-\x{9fa5}][A-Za-z]")
LABELLED_ACCOUNT = Rule("labelled_account", "账号", r"(?<=(?:账号|账户)[:：]?)[0-9]{6,30}", 0, 45, r"账")
DATE = Rule("date", "日期", r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日", 0, 80, r"年")
MONTH = Rule("month", "日期", r"[0-9]{4}年[0-9]{1,2}月(?![0-9]{1,2}日)", 0, 81, r"年")

#: Of numbers whose field is named right before them neither date nor check character must hold.
LABELLED_ID = Rule("labelled_id", "证件", r"(?<=(?:身份证|证件)(?:号码|号)?[:：]?)[0-9]{6}[ -]?[0-9]{8}[ -]?[0-9]{3}[0-9Xx](?![0-9Xx])", 0, 31, "证")
LABELLED_CREDIT = Rule("labelled_credit", "信用代码", r"(?<=(?:信用代码|税号)[:：]?)[0-9A-Z]{18}(?![0-9A-Z])", 0, 36, "[码号]")

#: Always on, in order of precedence.
FIXED = (EMAIL, INTL_PHONE, ID_CARD, CREDIT_CODE, CARD, LABELLED_ACCOUNT, MOBILE, LANDLINE, IPV4, MAC, PLATE)


def octets_ok(x: Column) -> Column:
    return F.forall(F.split(x, r"[.]"), lambda p: p.cast("int") <= 255)


def birth_ok(x: Column) -> Column:
    """Whether characters 7 to 14 of an ID number, separators left out, are a date."""
    return F.try_to_date(F.substring(F.regexp_replace(x, "[ -]", ""), 7, 8), "yyyyMMdd").isNotNull()


#: Weights and check characters of the 18-character ID number (GB 11643).
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"

#: Characters and weights of the unified credit code (GB 32100).
CREDIT_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
CREDIT_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def id_checksum_ok(x: Column) -> Column:
    digit = lambda n, i: F.call_function("div", n, F.lit(10 ** (16 - i))) % 10
    total = lambda n: sum((digit(n, i) * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))
    check = lambda n: F.substr(F.lit(ID_CHECKS), (total(n) % 11).cast("int") + 1, F.lit(1))
    right = lambda bare: let(F.substr(bare, F.lit(1), F.lit(17)).try_cast("bigint"), check) == F.substr(bare, F.lit(18), F.lit(1))
    return let(F.upper(F.regexp_replace(x, "[ -]", "")), lambda bare: F.when(~F.rlike(bare, F.lit("^[0-9]{17}[0-9X]\\z")), False).otherwise(right(bare)))


def credit_checksum_ok(x: Column) -> Column:
    place = lambda c: F.position(c, F.lit(CREDIT_CHARS)) - 1
    total = sum((place(F.substr(x, F.lit(i + 1), F.lit(1))) * w for i, w in enumerate(CREDIT_WEIGHTS)), F.lit(0))
    return (F.length(x) == 18) & ((31 - total % 31) % 31 == place(F.substr(x, F.lit(18), F.lit(1))))


#: What must hold of a hit besides its pattern.
CHECKS = {"ipv4": octets_ok, "id_card": birth_ok}


#: What masking asks for besides, of hits whose field isn't named: their check characters.
CHECKSUMS = {"id_card": id_checksum_ok, "credit_code": credit_checksum_ok}


def year_masked(x: Column) -> Column:
    """The third digit of each year before 年 becomes X."""
    return F.regexp_replace(x, "([0-9]{2})[0-9]([0-9])年", "$1X$2年")


def valid_date(x: Column) -> Column:
    """Whether a date names a day, or a year and month a month, that exists; others keep their year mask but get no code of their own."""
    return F.try_to_date(F.concat(F.regexp_replace(x, "[年月日]", "-"), F.when(F.endswith(x, F.lit("月")), "1-").otherwise("")), "yyyy-M-d-").isNotNull()


def amount_masked(value: Column, currency: Column, least: int = 1_000_000) -> Column:
    """From least on, the amount to half-even millions, as ``N万余`` and currency; null below."""
    return let(value, lambda v: F.when(v >= least, F.concat((F.bround(v.cast("decimal(24,2)"), -6) / 10_000).cast("bigint").cast("string"), F.lit("万余"), currency)))


def amount_value(x: Column) -> Column:
    """The number of an amount such as 14,523,900.00元 or 123万美元, as decimal; null if it has more than 22 digits."""
    number = F.replace(F.regexp_extract(x, r"^[0-9,]+(?:\.[0-9]+)?", 0), F.lit(","), F.lit("")).try_cast("decimal(24,2)")
    times = lambda unit: F.when(unit == "亿", 100_000_000).when(unit == "万", 10_000).when(unit == "千", 1_000).otherwise(1)
    return (number * let(F.regexp_extract(x, "^[0-9,.]+(亿|万|千)?", 1), times)).try_cast("decimal(24,2)")


AMOUNT = Rule("amount", "金额", r"(?<![0-9,.])[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?(?:亿|万|千)?(?:美元|欧元|港元|元)?|(?<![0-9,.])[0-9]+(?:\.[0-9]+)?(?:亿|万|千)?(?:美元|欧元|港元|元)", 0, 90, "元|,[0-9]{3}")

#: From here on an amount is masked.
LEAST_AMOUNT = 1_000_000


def amount_currency(x: Column) -> Column:
    """The currency that an amount ends in, 元 where it names none."""
    return let(F.regexp_extract(x, "(?:美元|欧元|港元|元)$", 0), lambda currency: F.when(currency == "", "元").otherwise(currency))


def full_digits(x: Column) -> Column:
    """A number of 10 ** 15 and more, given as text such as 6.2E18, in all its digits; else as it is."""
    d = x.try_cast("decimal(38,0)")
    return F.when(F.abs(d) >= 10**15, d.cast("string")).otherwise(x)


def formula_constants(formula: Column) -> Column:
    """Text between double quotes, doubled quotes resolved."""
    return F.transform(F.regexp_extract_all(formula, F.lit('"((?:[^"]|"")*)"'), F.lit(1)), lambda c: F.replace(c, F.lit('""'), F.lit('"')))


def address_fragments(x: Column) -> Column:
    """The prefixes of an address that end at 省, 市, 区, 县, 镇, 乡 or 村."""
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substr(x, i, F.lit(1)).isin(*"省市区县镇乡村"))
    return F.array_distinct(F.transform(cuts, lambda i: F.substr(x, F.lit(1), i)))


def api_base(url: Column) -> Column:
    """An API address that ends in /v1, or in a /v1beta it came with."""
    bare = F.regexp_replace(F.trim(url), r"/+$", "")
    bare = F.regexp_replace(bare, r"/(chat/completions|completions|models)$", "")
    return F.when(F.rlike(bare, F.lit(r"/v1(beta)?$")), bare).otherwise(F.concat(bare, F.lit("/v1")))
