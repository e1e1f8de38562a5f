"""Words, patterns, formats and tables that results depend on."""

# Investment opinion patterns in order of precedence, and words that mean "not rated".
OPINIONS = [
    (r"매수\s*[\[\(\]]?\s*(?:유지|신규|강력|적극)?\s*[\)\]]?", "BUY"),
    (r"(?i)(?<!Not\s)(?<!Under\s)BUY\s*[\[\(\]]?\s*(?:유지|신규|Maintain)?\s*[\)\]]?", "BUY"),
    (r"(?i)(?:Trading|Strong)\s*Buy", "BUY"),
    (r"(?i)Outperform", "BUY"),
    (r"중립|보유|시장수익률", "HOLD"),
    (r"(?i)NEUTRAL|HOLD|MARKET\s*PERFORM|MARKET\s*WEIGHT", "HOLD"),
    (r"매도|비중축소", "SELL"),
    (r"(?i)SELL|UNDER\s*PERFORM|UNDER\s*WEIGHT|REDUCE", "SELL"),
    (r"(?i)Not\s*Rated|NR\b|N/?R\b|N\.R\b|미제시", "NOT_RATED"),
]
NOT_RATED_WORDS = ["코넥스기업 분석보고서", "KONEX Research Project", "기술분석보고서"]

# Target and current price patterns.
TARGET_PRICE = (
    r"(?:목표|적정)(?:주가|가격|가)\s*(?:\(\d{1,2}M\)\s*:?\s*)?[^\d]*?([\d,]+\.?\d*)\s*(?:만)?\s*원|"
    r"\bTP\b\s*(?:\(\d{1,2}M\)\s*:?\s*)?[^\d]*?([\d,]+\.?\d*)\s*(?:만)?\s*원|"
    r"(?:목표|적정)(?:주가|가격)\s*(?:\(\d{1,2}M\)\s*:?\s*)?[^\d]*?([\d,]+\.?\d*)\s*(?:만)?\s*(?:원)?|"
    r"\bTP\b\s*(?:\(\d{1,2}M\)\s*:?\s*)?[^\d]*?([\d,]+\.?\d*)|"
    r"Target\s*Price[^\d]*?([\d,]+\.?\d*)|"
    r"적정(?:주가|가치)[^\d]*?([\d,]+\.?\d*)\s*(?:만)?\s*(?:원)?"
)
TARGET_PRICE_WORDS = ["목표", "TP", "target", "적정", "상승"]
TARGET_PRICE_NOT_AFTER = [r"목표주가\s*[\[\(\]]?\s*(?:괴리율|추이|변동추이|변동내역|평균|X\s*\d|×\s*\d)", r"목표주가(변동추이|괴리율|추이)"]
TARGET_PRICE_NOT_BEFORE = r"(달러|USD|달러기준|52주최저|52주최고)\b"
#: {} stands for the escaped number.
TARGET_PRICE_NOT_AROUND = [
    r"\b{}\s*(?:년|개월|배|분기|일|월|주)\b",
    r"\b{}\s*%",
    r"\b{}M\b",
    r"['‘’]\s*{}\s*(?:년|E\b)",
    r"\b{}\s*[\./]\s*\d{{1,2}}\s*[\./]\s*\d{{1,2}}",
    r"[X×]\s*{}\b",
    r"\b{}\s*[,;:]?\s*\n\s*[\d,]+",
]
#: Characters before a match's begin and after its begin or (for around) end that these patterns look at.
TARGET_PRICE_AFTER, TARGET_PRICE_BEFORE, TARGET_PRICE_AROUND, BARE_CODE_BEFORE = 20, 20, (10, 15), 30
#: The same for the unit of ten thousand won, of target and current prices.
TARGET_PRICE_UNIT, CURRENT_PRICE_UNIT = (10, 15), (5, 5)
CURRENT_PRICE = [r"현재(?:주가|가격?)\s*(?:\([^)]*\))?\s*:?\s*([\d,]+\.?\d*)\s*(?:만)?\s*원", r"현재(?:주가|가)\s*:?\s*([\d,]+\.?\d*)\s*(?:만)?\s*(?:원)?"]
TEN_THOUSAND_WON = r"만\s*원"

# Stock code patterns in order; (pattern, characters of the text that count, whether years are dropped).
STOCK_CODES = [
    (r"\((\d{6})(?:/[^)]*)?(?:[.,]\s*[A-Z]{1,3})?\)", None, False),
    (r"(?:^|\s)(\d{6})\s*(?:기업분석|종목분석|기업\s*Report|종목\s*Report|기업\s*Update)", None, False),
    (r"(\d{6})\s*/\s*(?:KONEX|KOSPI|KOSDAQ|KS|KQ|Not\s*Rated)\b", None, False),
    (r"(?i)(?:KONEX|코넥스)\s*:?\s*(\d{6})\b", None, False),
    (r"\b(\d{6})\s*\.?\s*(?:KS|KQ)\b", None, False),
    (r"(?m)^(\d{6})\s*$", 800, True),
    (r"(?<=[A-Za-z가-힣])\s+(\d{6})\b", 2000, True),
    (r"\[[^\]]*?(\d{6})\s*\]", None, False),
]

# Estimate patterns.
REVENUE = r"(?i)매출(?:액)?[^\d]*?(\d{1,3}(?:[.,]\d{1,2})?)\s*(?:조|십억|억|백만|만)?\s*(?:원)?"
OPERATING_PROFIT = r"(?i)영업이익[^\d]*?(\d{1,3}(?:[.,]\d{1,2})?)\s*(?:조|십억|억|백만|만)?\s*(?:원)?"

# Markers where boilerplate begins.
BOILERPLATE = [
    r"Compliance\s*Notice",
    r"고지\s*사항",
    r"Disclaimer",
    r"투자의견\s*변동\s*내역",
    r"투자의견\s*및\s*목표주가\s*추이",
    r"투자등급\s*비율",
    r"종목추천\s*투자등급",
    r"투자의견\s*분류",
    r"본\s*조사분석자료",
    r"본\s*분석자료는",
    r"무단\s*전재",
    r"무단으로\s*인용",
]

# Lines of reports.
NUMERIC_VALUE = r"[-+]?\d[\d,]*(?:\.\d+)?\s*(?:%|원|억원|십억원|조원|배|x|X)?|N/A|n/a|적자|흑자"
PAGE_LINE = r"\d{1,2}\s*/\s*\d{1,2}"
METRICS = r"매출|매출액|영업수익|영업이익|영업손익|세전이익|당기순이익|순이익|지배주주|EBITDA|EPS|BPS|DPS|PER|PBR|ROE|ROA|EV/EBITDA|영업이익률|순이익률|부채비율|순차입금|현금흐름|CAPEX|FCF|자산총계|부채총계|자본총계|Revenue|Sales|Operating Profit|Net Profit|Margin"

# Company names.
LEGAL_TOKENS = ["주식회사", "(주)", "㈜", "(유)", "유한회사", "(재)", "(사)", "co.,ltd", "co.ltd", "corp", "inc"]

# Report names and types.
CORRECTIONS = ["[기재정정]", "[첨부정정]", "[첨부추가]", "[변경등록]", "[연장결정]", "[발행조건확정]", "[정정명령부과]", "[정정제출요구]"]
REGULAR_REPORTS = {"사업보고서": "11011", "반기보고서": "11012", "분기보고서": "11014", "1분기보고서": "11013", "3분기보고서": "11014"}
SECURITIES_REPORTS = ["증권신고서", "일괄신고서", "일괄신고추가서류", "투자설명서"]
REGULAR_FILINGS = "사업보고서|반기보고서|분기보고서|감사보고서제출|사업연도|기업가치제고계획"
MAJOR_EVENTS = "주요사항보고|유상증자|무상증자|감자|부도발생|회생절차|합병|분할|영업양도|주요자산처분|타법인|최대주주변경|자기주식취득|단일판매|소송제기|CB발행|BW발행|EB발행"
TYPE_IMPORTANCE = {"MATERIAL_EVENT": 0.9, "OWNERSHIP": 0.6, "SECURITIES_REGISTRATION": 0.3, "REGULAR": 0.5, "DISCLOSURE": 0.0}
SECTION_IMPORTANCE = {
    "exctvSttus": 0.7, "hyslrChgHist": 0.7, "financials": 0.7, "hyslrSttus": 0.6, "tesstkAcqsDspsSttus": 0.5, "alotMatter": 0.5,
    "emplyMttrs": 0.5, "irdsSttus": 0.5, "piTickCrtfcList": 0.4, "majorstock": 0.6, "elestock": 0.6, "company_overview": 0.4,
}
TYPE_LABELS = {"REGULAR": "정기보고서", "MATERIAL_EVENT": "주요사항보고서", "OWNERSHIP": "지분공시", "SECURITIES_REGISTRATION": "증권신고서", "DISCLOSURE": "공시"}
NO_KEYWORD = "미분류"
KEY_ACCOUNTS = [("매출액", ["매출액"]), ("영업이익", ["영업이익(손실)"]), ("당기순이익", ["당기순이익(손실)"]), ("자산총계", ["자산총계"]), ("자본총계", ["자본총계"])]

# Texts that count as empty.
EMPTY_TEXT = ["", "nan", "none", "null", "-"]

# Industry sections (first division, last division, letter, name) and divisions.
INDUSTRY_SECTIONS = [
    (1, 3, "A", "농업, 임업 및 어업"),
    (5, 8, "B", "광업"),
    (10, 34, "C", "제조업"),
    (35, 35, "D", "전기, 가스, 증기 및 공기 조절 공급업"),
    (36, 39, "E", "수도, 하수 및 폐기물 처리, 원료 재생업"),
    (41, 42, "F", "건설업"),
    (45, 47, "G", "도매 및 소매업"),
    (49, 52, "H", "운수 및 창고업"),
    (55, 56, "I", "숙박 및 음식점업"),
    (58, 63, "J", "정보통신업"),
    (64, 66, "K", "금융 및 보험업"),
    (68, 68, "L", "부동산업"),
    (70, 73, "M", "전문, 과학 및 기술 서비스업"),
    (74, 76, "N", "사업시설 관리, 사업 지원 및 임대 서비스업"),
    (84, 84, "O", "공공행정, 국방 및 사회보장 행정"),
    (85, 85, "P", "교육 서비스업"),
    (86, 87, "Q", "보건업 및 사회복지 서비스업"),
    (90, 91, "R", "예술, 스포츠 및 여가관련 서비스업"),
    (94, 96, "S", "협회 및 단체, 수리 및 기타 개인 서비스업"),
    (97, 98, "T", "가구 내 고용활동 등"),
    (99, 99, "U", "국제 및 외국기관"),
]
INDUSTRY_DIVISIONS = {
    "10": "식료품 제조업", "20": "화학 물질 및 화학제품 제조업; 의약품 제외", "21": "의료용 물질 및 의약품 제조업",
    "22": "고무 및 플라스틱제품 제조업", "24": "1차 금속 제조업", "25": "금속 가공제품 제조업; 기계 및 가구 제외",
    "26": "전자부품, 컴퓨터, 영상, 음향 및 통신장비 제조업", "27": "의료, 정밀, 광학 기기 및 시계 제조업", "28": "전기장비 제조업",
    "29": "기타 기계 및 장비 제조업", "30": "자동차 및 트레일러 제조업", "35": "전기, 가스, 증기 및 공기 조절 공급업",
    "41": "종합 건설업", "46": "도매 및 상품 중개업", "47": "소매업; 자동차 제외", "58": "출판업",
    "62": "컴퓨터 프로그래밍, 시스템 통합 및 관리업", "63": "정보서비스업", "64": "금융업", "65": "보험 및 연금업",
    "66": "금융 및 보험 관련 서비스업", "68": "부동산업", "70": "연구개발업",
}

# Words that name a question's subject.
DISCLOSURE_WORDS = ["공시", "dart", "opendart", "전자공시", "사업보고서", "분기보고서", "반기보고서", "정기보고서", "주요사항보고서", "증권신고서", "접수번호", "rcept_no", "rcept"]
FINANCIAL_WORDS = ["재무제표", "재무", "매출", "영업이익", "당기순이익", "순이익", "자산", "부채", "자본", "per", "pbr", "실적"]
INSIDER_WORDS = ["내부자", "임원 매수", "임원 매도", "임원 거래", "임원매수", "임원매도", "임원거래", "주식등의대량보유", "대량보유"]
SHAREHOLDER_WORDS = ["주요주주", "최대주주", "대주주", "주주현황", "지분율", "지분 변동", "지분변동"]
REPORT_WORDS = ["리포트", "증권사", "애널리스트", "목표주가", "목표가", "투자의견", "상승여력", "broker", "report"]
