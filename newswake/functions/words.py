"""Word lists and lookup tables. All are fixed values; the larger lexicons are read from files.

See `newswake.sources.lexicons` for the file formats of the label registry and of the keyword
lexicon, which are parameters of the operators that use them.
"""

# fixed values: article wording
HEDGING = [
    "설", "소문", "관측", "검토", "알려졌다", "가능성", "유력", "전해졌다", "복수의 관계자", "익명",
    "소식통", "카더라", "관계자에 따르면", "추정", "예상", "전망",
]
CONFIRM = ["공시", "보도자료", "확정", "발표", "체결", "승인", "인허가", "공식", "답변", "확인"]
DENIAL = [
    "사실무근", "해당 사항 없음", "부인", "검토한 바 없다", "추진 사실 없다", "해당사항없음", "부정",
    "확인된바없", "검토한바없", "추진사실없", "계획없", "근거없", "사실과다름",
]
TITLE_HINTS = ["?", "단독"]

# fixed values: disclosure report names
EXCHANGE_TYPES = ["I"]
DECISION = [
    "결정", "체결", "승인", "취득", "양수", "양도", "합병", "분할", "단일판매", "공급계약",
    "주요사항보고서", "증권발행", "유상증자", "감자", "전환사채", "신주인수권부사채", "교환사채", "전환",
    "자기주식", "소각", "배당", "실적", "매출",
]
QUERY = ["조회공시", "현저한 시황변동", "풍문", "보도", "루머", "추측성", "확인요청", "해명요구", "설명요청"]
ANSWER = ["답변", "회신", "설명", "입장발표", "공식발표", "안내"]
CONTRACT = ["공급계약", "수주", "계약체결", "판매계약", "용역계약", "건설계약"]

# fixed values: wording that contradicts a rumor, and wording that makes a claim
CONTRADICTION = [
    "부인", "사실무근", "해명", "아니다", "없다", "틀렸다", "조회공시", "해당사항없음", "검토한바없",
    "추진사실없", "계획없", "근거없", "사실과다름", "허위", "오보",
]
CLAIM_TERMS = [
    "인수", "매각", "투자", "확대", "발표", "체결", "결정", "합병", "계약", "수주", "증자", "감자",
    "상장", "폐쇄",
]

# fixed values: query terms that name an event
EVENT_TERMS = [
    "자금난", "유동성 위기", "유동성 경색", "증자", "유상증자", "전환사채", "워크아웃", "채권단", "구조조정",
    "자산 매각", "인수합병", "M&A", "부도", "회생", "파산", "감자", "CB", "BW", "차환", "디폴트", "채무불이행",
]
EVENT_NAMES = {
    "liquidity_crunch": "자금부족", "rights_issue": "유상증자", "cb_issue": "전환사채",
    "workout": "워크아웃", "asset_sale": "자산 매각",
}

# fixed values: analyst reports are recognised by a broker up front and a report word anywhere
BROKERS = [
    "미래에셋증권", "삼성증권", "KB증권", "한국투자증권", "NH투자증권", "신한투자증권", "하나증권",
    "메리츠증권", "키움증권", "대신증권", "유안타증권", "SK증권", "한화투자증권", "교보증권",
    "IBK투자증권", "현대차증권", "유진투자증권", "이베스트투자증권", "하이투자증권", "케이프투자증권",
    "DB금융투자", "토스증권", "한양증권", "JP모간", "골드만삭스", "모건스탠리", "UBS", "크레디트스위스",
    "HSBC", "씨티그룹", "도이치", "BNP파리바", "노무라", "CLSA", "맥쿼리",
]
REPORT_WORDS = [
    "목표가", "목표주가", "투자의견", "상향", "하향", "유지", "매수", "매도", "중립", "보유", "Buy",
    "Sell", "Hold", "컨센서스", "TP", "애널리스트", "리서치", "리포트", "실적 전망", "실적 예상",
    "밸류에이션", "레이팅", "커버리지",
]

# fixed values: group names that do not count as a company when a particle follows
GROUPS = ["현대", "삼성", "LG", "SK"]
PARTICLES = ["에는", "는", "에서", "의", "에게", "에", "으로", "로", "만", "도"]

# fixed values: words that are never a company, and context words per sector
NOT_A_COMPANY = [
    "회사", "기업", "업체", "업계", "그룹사", "계열사", "모두", "전체", "각각", "또한", "그리고",
    "하지만", "이번", "올해", "내년", "최근", "새로운",
]
SECTOR_WORDS = {
    "전자": ["반도체", "디스플레이", "가전", "스마트폰"],
    "자동차": ["전기차", "내연기관", "모빌리티", "자율주행"],
    "화학": ["석유화학", "소재", "배터리"],
    "조선": ["선박", "해양플랜트", "조선업"],
    "건설": ["부동산", "아파트", "건축"],
    "IT": ["플랫폼", "소프트웨어", "인공지능"],
    "금융": ["은행", "증권", "보험", "핀테크"],
}
KEY_SECTORS = ["전자", "자동차", "IT", "반도체"]

# fixed values: report-name keywords expected for a label
LABEL_REPORT_WORDS = {
    "company.earnings_result": [
        "잠정실적", "연결재무제표", "별도재무제표", "분기보고서", "반기보고서", "사업보고서", "실적발표",
        "매출액또는손익구조", "영업이익", "당기순이익", "매출현황"],
    "company.earnings_forecast": ["실적예상", "실적전망", "공정공시", "영업실적예고", "실적가이던스"],
    "company.mna_acquisition": [
        "주식양수", "영업양수", "자산양수", "지분취득", "인수합병", "합병결정", "합병계약",
        "주요사항보고서(회사합병)", "타법인주식및출자증권취득결정"],
    "company.mna_divestiture": [
        "주식양도", "영업양도", "자산양도", "지분매각", "매각결정", "타법인주식및출자증권처분결정"],
    "company.mna_letter_of_intent": ["양해각서", "MOU", "LOI", "인수의향서", "매각의향서", "조회공시"],
    "company.financing_equity": [
        "유상증자", "무상증자", "주식발행", "신주발행", "증자결정", "제3자배정", "주주배정", "일반공모",
        "전환사채", "신주인수권부사채"],
    "company.financing_debt": ["사채발행", "차입금", "대출", "회사채", "CB발행", "BW발행", "EB발행"],
    "company.capex_expansion": [
        "시설투자", "설비투자", "공장건설", "생산능력확대", "증설", "신규사업", "사업확장", "투자계획"],
    "company.contract_win": [
        "공급계약", "수주", "계약체결", "판매계약", "용역계약", "건설계약", "계약", "체결", "수주", "공급",
        "판매", "구매", "양수", "양도", "인수", "매각", "투자"],
    "company.contract_termination": ["계약해지", "계약취소", "계약파기", "계약종료"],
    "company.restructuring_workout": ["워크아웃", "기업개선작업", "채무재조정", "자율협약", "경영정상화"],
    "company.restructuring_bankruptcy": ["회생절차", "법정관리", "파산", "청산", "상장폐지"],
    "company.regulatory_approval": ["인허가", "승인", "허가취득", "임상승인", "품목허가"],
    "company.regulatory_penalty": ["제재", "과징금", "영업정지", "시정명령", "벌금", "징계"],
    "company.dividend": ["배당", "현금배당", "주식배당", "중간배당", "배당결정"],
    "company.stock_buyback": ["자기주식", "자사주", "주식취득", "주식소각", "자기주식처분"],
}

# fixed values: report words that make a category match strong, with the score it then gets
STRONG_REPORT_WORDS = {
    "earnings": (0.9, [
        "잠정실적", "연결재무제표", "별도재무제표", "분기보고서", "반기보고서", "사업보고서", "영업실적",
        "매출액또는손익구조", "공정공시", "실적공시", "어닝", "매출현황", "손익계산서"]),
    "mna": (0.85, [
        "주식양수", "주식양도", "영업양수", "영업양도", "합병", "인수", "매각", "지분취득", "지분매각",
        "MOU", "LOI", "타법인주식", "출자증권", "경영권", "지배력"]),
    "investment": (0.8, [
        "시설투자", "설비투자", "공장", "생산능력", "증설", "신규사업", "capex", "투자결정", "착공", "준공"]),
    "financing": (0.8, [
        "유상증자", "무상증자", "사채발행", "전환사채", "신주인수권", "CB", "BW", "EB", "자금조달", "차입",
        "회사채"]),
}
HIGH_UNCERTAINTY = ["검토 중", "협의 중", "논의 중", "TBD", "미정", "미확정"]
