"""Rubrics of the internal assessment tables of items 4, 5 and 6."""

TITLES = {"4": "하도급 제도", "5": "SW사업 작업장소(원격개발)", "6": "SW사업 산출물 활용 보장"}

# item, row number, title, content, requirement term lists, matches for a full statement, action when missing
ROWS = [
    ("4", "1", "<하도급 사전 승인>", "하도급 계약시 발주기관으로부터 하도급 사전 승인을 받도록 안내",
     [["하도급", "사전승인"]], 1,
     "하도급 계약 시 발주기관으로부터 하도급 사전 승인을 받도록 안내하시기 바랍니다."),
    ("4", "2", "<하도급 비율 제한>", "하도급 허용시 하도급 비율은 50%를 초과할 수 없음을 안내",
     [["하도급", "50", "초과할수없"], ["하도급", "100분의50"]], 1,
     "하도급 허용 시 하도급 비율은 50%를 초과할 수 없음을 안내하시기 바랍니다."),
    ("4", "3", "<재하도급 원칙적 불허>", "하도급 허용시 재하도급을 원칙적으로 불허함을 안내",
     [["재하도급", "불허"], ["다시하도급", "불허"], ["하도급", "원칙적으로불허"]], 1,
     "하도급 허용 시 재하도급을 원칙적으로 불허함을 안내하시기 바랍니다."),
    ("4", "4", "<하도급 계획서 제출>", "계약체결시 (원)도급자는 발주기관에게 하도급 계획서를 제출하도록 안내",
     [["하도급", "계획서", "제출"], ["계약체결", "하도급계획서"]], 1,
     "계약체결 시 (원)도급자가 발주기관에게 하도급 계획서를 제출하도록 안내하시기 바랍니다."),
    ("4", "5", "<하도급 계획 적정성 확인서 제출>",
     "'하도급계획 적정성'을 기술성 평가항목에 포함하는 사업으로, 입찰 시 (원)도급자는 "
     '발주기관에게 "소프트웨어사업 하도급 계획 적정성 확인서"를 제출하도록 안내',
     [["하도급계획적정성확인서"], ["하도급", "적정성", "평가항목"], ["하도급계약", "적정성", "세부기준"]], 1,
     '입찰 시 "소프트웨어사업 하도급 계획 적정성 확인서" 제출 안내를 명시하시기 바랍니다.'),
    ("4", "6", "<하도급 계약 적정성 판단기준>", "발주기관은 하도급 계약의 적정성 판단기준을 사전에 정하여 안내",
     [["하도급", "적정성", "판단"], ["하도급계약", "적정성", "세부기준"]], 1,
     "하도급 계약의 적정성 판단기준을 사전에 정하여 안내하시기 바랍니다."),
    ("5", "1", "<작업장소 상호협의 등>",
     "제안요청서 등에 작업장소 상호협의 또는 제공여부 등을 명시하고 있는지 여부(작업장소 등 관련 비용 계상여부 포함)",
     [["작업장소", "상호", "협의"], ["작업장소", "제공"], ["작업장소", "비용"], ["제안가격", "포함"]], 1,
     "작업장소 상호협의 또는 제공여부와 작업장소 관련 비용 계상여부를 명시하시기 바랍니다."),
    ("5", "2", "<원격지 개발 장소 제시·검토 절차>",
     "제안요청서 등에 공급자에 의한 작업장소 제시 및 그에 따른 발주기관의 검토절차 등을 명시하고 있는지 여부",
     [["원격지", "개발", "장소", "제시"], ["작업장소", "제시"], ["발주기관", "검토"], ["검토", "절차"]], 1,
     "공급자의 원격지 개발 장소 제시와 발주기관의 검토절차를 명시하시기 바랍니다."),
    ("5", "3", "<원격지 개발 장소 보안요구사항>", "제안요청서 내에 작업장소 관련 보안요구사항을 명시하고 있는지 여부",
     [["원격지", "보안"], ["작업장소", "보안"], ["보안", "요구사항"], ["출입", "통제"], ["저장매체", "반출"]], 1,
     "원격지 개발 장소 및 작업장소 관련 보안요구사항을 명시하시기 바랍니다."),
    ("6", "1", "<지식재산권 공동귀속>",
     "제안요청서 등에 지식재산의 공동귀속 적용 여부. 발주기관 귀속의 경우 계약목적물의 특수성에 따른 구체적 사유가 명시되어 있는지 여부",
     [["지식재산", "공동귀속"], ["지식재산", "공동소유"], ["지식재산권", "공동"], ["계약목적물", "지식재산권"],
      ["공동", "귀속"], ["공동", "소유"]], 1,
     "지식재산권 공동귀속 적용 여부를 명시하시기 바랍니다."),
    ("6", "2", "<SW산출물 반출 절차 등>",
     "제안요청서 내 SW산출물 활용촉진을 위한 반출절차 적용 여부, 반출 요청절차, "
     "누출금지정보 삭제 및 확약서 제출, 제3자 제공 시 사전승인, 위반 시 입찰참가자격 제한 명시 여부",
     [["SW산출물", "반출", "요청"], ["산출물", "반출", "절차"], ["누출금지정보", "삭제"], ["확약서", "제출"],
      ["제3자", "사전승인"], ["입찰참가자격", "제한"]], 5,
     "SW산출물 반출 요청절차, 누출금지정보 삭제 및 확약서 제출, 제3자 제공 시 사전승인, 위반 시 입찰참가자격 제한 내용을 명시하시기 바랍니다."),
]
STATED, PARTLY, UNSTATED = "명시", "일부명시", "미명시"
R_ALL = "내부 검토표의 모든 항목이 RFP 근거에서 명시로 확인되었습니다."
R_ALL_EDITED = "내부 검토표의 모든 항목이 명시되어 있습니다."
R_MISSING = "명시가 부족한 내부 항목: "
EDIT_DEFAULT = "미명시 항목을 보완하시기 바랍니다."
COLUMNS = "구분\t내용\t명시 여부"
