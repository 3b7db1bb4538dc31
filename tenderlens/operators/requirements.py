"""Requirements of single items as named predicates on compact page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlens.functions.text import contains_all, contains_any


def subcontract_requirements(c: Column) -> dict[str, Column]:
    sub = c.contains("하도급")
    return {
        "oversight_correction": sub & contains_all(c, ["관리", "감독", "시정", "요구"]),
        "prior_approval": sub & c.contains("사전승인"),
        "ratio_limit": sub & contains_any(c, ["100분의50", "50%"]) & c.contains("초과할수없"),
        "plan_submission": sub & c.contains("계획서") & contains_any(c, ["제출", "계약체결"]),
        "approval_criteria": sub & contains_all(c, ["적정성", "85점"]) & contains_any(c, ["승인", "판단"]),
        "joint_consortium": sub & contains_any(c, ["10%", "10퍼센트"]) & c.contains("공동수급체"),
    }


def output_term(c: Column) -> Column:
    return contains_any(F.replace(c, F.lit("S/W"), F.lit("SW")), ["SW산출물", "소프트웨어산출물", "계약산출물"])


def reuse_requirements(c: Column) -> dict[str, Column]:
    output = output_term(c)
    scope = output | contains_any(
        c, ["SW사업산출물활용보장", "계약목적물", "계약산출물", "지식재산권", "계약상대자", "공급자", "활용승인"]
    )
    joint = contains_any(c, ["공동소유", "공동으로소유", "공동귀속"]) | (
        c.contains("공동") & contains_any(c, ["활용", "소유", "귀속"])
    )
    owner = c.contains("귀속") & contains_any(c, ["발주기관", "주관기관", "계약상대자"])
    removal = ["삭제하고", "삭제후", "삭제한후", "삭제하여", "삭제해야", "삭제하여야", "제거하고", "제거하여"]
    by_head = contains_any(c, ["대표명의", "대표자명의"]) | (c.contains("공급자") & contains_any(c, ["명의", "대표"]))
    breach = ["무단유출", "무단으로유출", "누출되는경우", "누출금지정보를삭제하지", "삭제하지않고활용"]
    return {
        "ip_ownership": contains_any(c, ["지식재산권", "계약목적물"]) & (joint | owner),
        "export_allowed": output & c.contains("반출") & contains_any(c, ["요청할수", "가능", "제공", "반출할수"]),
        "export_request": output & c.contains("반출") & contains_any(c, ["요청", "절차", "검토", "통보"]),
        "secret_removal": scope & c.contains("누출금지정보") & contains_any(c, removal),
        "confirmation_letter": scope & c.contains("확약서") & contains_any(c, ["제출", "제시"]) & by_head,
        "third_party_approval": scope & c.contains("제3자") & contains_any(c, ["사전승인", "사전승낙", "발주기관의승인"]),
        "bid_restriction": scope & contains_all(c, ["입찰참가자격", "제한"]) & contains_any(c, breach) & output,
    }


REUSE_ALL = 127


def reuse_section_signal(c: Column, mask: Column) -> Column:
    """The page belongs to the section on reuse of outputs."""
    both = mask.bitwiseAND(3) == 3
    party = contains_any(c, ["계약목적물", "계약산출물", "계약상대자", "공급자"])
    return c.contains("SW사업산출물활용보장") | contains_all(c, ["산출물활용", "지식재산권"]) | (both & party)


def reuse_score(c: Column, mask: Column) -> Column:
    def points(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    return (
        F.bit_count(mask) * 10
        + points(c.contains("SW사업산출물활용보장"), 20)
        + points(c.contains("산출물활용"), 8)
        + points(contains_any(c, ["계약목적물", "계약산출물"]), 6)
        + points(c.contains("제재요건"), 4)
    )


# The word quoted for each requirement, in order of preference.
REUSE_QUOTES = ["지식재산권", "산출물", "반출", "누출금지", "확약서", "제3자", "입찰참가자격"]
