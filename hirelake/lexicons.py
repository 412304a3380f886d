"""Word lists and weights of the engine's default (Korean) rules.

Fixed values: results depend on these lists and, where noted, on their order. Every operator takes
its lists as parameters, with these as defaults.
"""

WEIGHTS = {"role": 20, "skills": 30, "location": 10, "employment_type": 8, "welfare": 8, "salary": 8, "company_industry": 6, "etc": 10}

METRO = ["서울", "경기", "인천", "수도권"]
BENEFITS = ["식대", "재택근무", "건강검진", "교육비", "사내스터디", "컨퍼런스참가비", "운동비", "도서구입비", "경조사비", "경조휴가", "스톡옵션", "자율출퇴근제"]
#: (parts that a token must all contain, its canonical benefit); the first rule that fits counts.
WELFARE_RULES = [
    (["재택"], "재택근무"),
    (["검진"], "건강검진"),
    (["자율", "출퇴근"], "자율출퇴근제"),
    (["식", "대"], "식대"),
    (["컨퍼런스"], "컨퍼런스참가비"),
    (["스터디"], "사내스터디"),
    (["도서"], "도서구입비"),
    (["운동"], "운동비"),
    (["경조", "휴"], "경조휴가"),
    (["경조"], "경조사비"),
    (["스톡"], "스톡옵션"),
    (["교", "육", "비"], "교육비"),
]
BENEFIT_SYNONYMS = {
    "재택": "재택근무",
    "원격": "재택근무",
    "리모트": "재택근무",
    "건강 검진": "건강검진",
    "헬스비": "운동비",
    "체력단련비": "운동비",
    "책구입비": "도서구입비",
    "스터디": "사내스터디",
    "컨퍼런스": "컨퍼런스참가비",
    "행사비": "경조사비",
    "경조휴무": "경조휴가",
    "스톡옵션": "스톡옵션",
    "자율 근무제": "자율출퇴근제",
}
METRO_NAMES = ["서울", "경기", "경기도", "인천", "수도권", "판교", "성남", "분당", "강남", "서초", "송파", "마포", "여의도"]
PROVINCE_NAMES = ["부산", "대구", "광주", "대전", "울산", "세종", "창원", "전주", "제주", "강원", "충북", "충남", "전북", "전남", "경북", "경남"]
#: Order is that of results.
TECH = [
    "python", "django", "flask", "fastapi", "celery", "java", "spring", "kotlin", "scala", "javascript", "typescript", "node", "express", "nest", "react", "vue",
    "svelte", "next", "nuxt", "go", "golang", "rust", "c#", ".net", "php", "laravel", "sql", "mysql", "mariadb", "postgres", "mongodb", "redis", "elasticsearch",
    "aws", "azure", "gcp", "docker", "kubernetes", "linux", "git", "airflow", "pytorch", "tensorflow", "sklearn", "bert", "transformers", "xgboost", "lightgbm",
]
TECH_UPPER = ["aws", "gcp", "sql"]
#: (label, keys); the first label with a key in the text counts.
INDUSTRIES = [
    ("클라우드", ["cloud", "클라우드", "saas"]),
    ("플랫폼", ["플랫폼", "platform"]),
    ("이커머스", ["커머스", "e-commerce", "ecommerce", "쇼핑몰"]),
    ("핀테크", ["핀테크", "fintech", "결제"]),
    ("게임", ["game", "게임"]),
    ("ai", ["ai", "머신러닝", "인공지능", "딥러닝"]),
    ("백엔드", ["backend", "백엔드"]),
    ("데이터", ["data", "데이터"]),
]
STRONG_TRIGGERS = ["반드시", "필수", "꼭", "무조건", "필히"]
REQUIRED_PLACE = ["근무지", "지역", "위치", "재택", "원격", "수도권", "지방 가능", "지역 무관"]
REQUIRED_PAY, REQUIRED_PAY_LIMITS = ["연봉", "급여", "보상"], ["최소", "이상", "이하"]
REQUIRED_WELFARE = ["복지", "복리", "식대", "재택", "건강검진", "자율출퇴근", "교육비", "사내스터디", "컨퍼런스", "도서구입비", "경조휴가", "경조사비", "스톡옵션"]
REQUIRED_CAREER = ["신입", "경력"]

JOB_ANCHORS = ["채용", "모집", "인턴", "구인", "경력", "신입", "구합니다", "recruit", "recruitment", "job", "jobs", "career", "careers"]
EXCLUDED_ANCHORS = ["모집절차", "모집 절차", "채용 절차", "전형 절차", "지원 절차", "지원서 수정", "지원서 확인", "나의 지원서", "지원 현황", "faq"]
EXTERNAL_DOMAINS = ["wanted.co.kr", "saramin.co.kr", "jobkorea.co.kr"]
ACCEPT_KEYWORDS = ["채용", "모집", "지원", "입사지원", "jobs", "recruit", "position", "경력", "신입"]
REGIONS = ["서울", "경기", "인천", "부산", "대구", "대전", "광주", "울산", "세종", "충북", "충남", "전북", "전남", "경북", "경남", "강원", "제주"]
EMPLOYMENT_TYPES = ["정규직", "계약직", "인턴", "파트타임"]
SECTION_TERMS = ["주요 업무", "담당 업무", "자격 요건", "자격요건", "우대 사항", "우대사항", "전형 절차", "채용 절차", "복리후생", "혜택", "근무 조건", "Requirements", "Preferred", "Process"]
#: Overlapping entries count each.
PRIORITY_KEYWORDS = [
    "채용공고", "채용 안내", "채용안내", "채용 정보", "채용정보", "채용", "인재채용", "인재 모집", "recruit", "recruitment", "career", "careers", "jobs", "employment",
    "join us", "입사지원", "채용사이트가기", "채용중인공고", "채용사이트", "채용절차", "openpositions", "집중채용", "채용공고 확인하기",
]
LISTING_WORDS = ["채용", "recruit", "career", "jobs", "job", "employment"]
ONE_PAGE_WORDS = ["채용", "recruit", "career", "입사지원", "지원방법"]
#: Hosts without a leading www.
BLOCKED_HOSTS = [
    "duckduckgo.com", "google.com", "naver.com", "search.naver.com", "bing.com", "jobkorea.co.kr", "saramin.co.kr", "rocketpunch.com", "linkedin.com",
    "kr.linkedin.com", "thevc.kr", "nextunicorn.kr", "bizno.net", "nicebizinfo.com", "incruit.com", "jobplanet.co.kr", "weverse.io",
]
#: Longest stored text of each posting field.
FIELD_LIMITS = {
    "title": 255, "job_description": 20000, "qualifications": 10000, "preferred_qualifications": 10000, "hiring_process": 5000, "benefits": 5000,
    "hiring_message": 5000, "location": 255, "employment_type": 50, "salary": 255, "work_hours": 100,
}

#: Labels of a posting's sections, and how its pay is written (fixed values).
SECTION_LABELS = {
    "job_description": ["주요 업무", "담당 업무", "Main Duties", "What you will do"],
    "qualifications": ["자격 요건", "자격요건", "필수 요건", "Requirements"],
    "preferred_qualifications": ["우대 사항", "우대사항", "우대 조건", "Preferred"],
    "hiring_process": ["전형 절차", "채용 절차", "전형절차", "Process"],
}
PAY_HEADS = "연봉|급여"
PAY_UNITS = r"\d[\d,\.]+ ?만원|\d[\d,\.]+ ?억|협의"
