"""Rule sets of tokenizing and tagging.  Every function takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists, patterns and labels that results depend on.
COMPOUNDS = (("열 에너지", "열에너지"), ("열 용량", "열용량"), ("가열 곡선", "가열곡선"), ("상태 변화", "상태변화"), ("입자 모형", "입자모형"))
PARTICLES = (
    "으로부터", "에게서", "이랑", "이라면", "이라고", "이라는", "입니다", "인가요", "이에요", "예요", "에서는", "에게",
    "한테", "부터", "까지", "보다", "처럼", "만큼", "으로", "에서", "에는", "은", "는", "이", "가", "을", "를", "의",
    "와", "과", "도", "만", "에", "로", "요",
)
STOPWORDS = ("그", "이", "저", "것", "거", "수", "좀", "네", "예", "응", "음", "어", "자")
TOPICS = (
    ("열용량·비열", ("열용량", "비열", "열량", "칼로리")),
    ("상태 변화·열에너지", ("상태 변화", "열에너지", "열 에너지", "흡수", "방출", "고체", "액체", "기체")),
    ("가열 곡선·끓는점", ("가열 곡선", "가열곡선", "가열 시간", "끓는점")),
    ("입자 모형", ("입자 모형", "입자의 운동")),
    ("숙제·퀴즈 피드백", ("숙제", "퀴즈", "정답률", "실수")),
)
TERMS = ("열용량", "비열", "열량", "열에너지", "상태 변화", "고체", "액체", "기체", "융해", "응고", "기화", "액화", "승화", "끓는점", "가열 곡선", "입자 모형")
CONTENT_TYPES = (
    ("문제 풀이", ("보기", "정답", "문제 풀이")),
    ("개념 설명", ("정의", "의미", "뜻", "원리", "개념", "설명을 하면")),
    ("수업 운영·피드백", ("숙제", "퀴즈", "정답률", "수업 들어")),
)
GENERIC_TERMS = ("오늘", "수업", "문제", "학생", "선생님", "퀴즈", "내용", "설명", "대답", "어떻게", "뭐야", "이유", "무엇")


@dataclass(frozen=True)
class TermRules:
    """How texts become search terms; the default is for Korean.

    ``stem_class`` is the class of letters whose tokens lose the first of ``suffixes`` that they end in,
    and give two- and three-letter grams.  ``nfkc`` is worth its Python call only for text that isn't
    already in that form.
    """

    token_pattern: str = r"[A-Za-z]+[A-Za-z0-9]*|\p{Nd}+(?:\.\p{Nd}+)?|[가-힣]+"
    compounds: tuple[tuple[str, str], ...] = COMPOUNDS
    suffixes: tuple[str, ...] = PARTICLES
    stopwords: tuple[str, ...] = STOPWORDS
    stem_class: str = "[가-힣]+"
    min_root: int = 2
    ngrams: bool = True
    nfkc: bool = True


@dataclass(frozen=True)
class TagRules:
    """How chunks are tagged; the default is for chemistry lessons in Korean."""

    topics: tuple[tuple[str, tuple[str, ...]], ...] = TOPICS
    compounds: tuple[tuple[str, str], ...] = COMPOUNDS[:1]
    exercise_topic: str = "문제 풀이"
    exercise_words: tuple[str, ...] = ("보기", "정답", "문제")
    default_topic: str = "일반 수업 대화"
    content_types: tuple[tuple[str, tuple[str, ...]], ...] = CONTENT_TYPES
    numbered_type: str = "문제 풀이"
    dialogue_type: str = "교사-학생 대화"
    dialogue_after: str = "개념 설명"
    default_type: str = "교사 설명"
    terms: tuple[str, ...] = TERMS
    number_unit: str = "번"
    nfkc: bool = True


LATIN_TERMS = TermRules(compounds=(), suffixes=("ation", "tion", "ing", "ed", "es", "s"), stopwords=("the", "a", "of", "and", "de", "la", "der", "un"), stem_class="[a-z]+", nfkc=False)
LATIN_EXACT = TermRules(compounds=(), suffixes=("ation", "tion", "ing", "ed", "es", "s"), stopwords=("the", "a", "of", "and", "de", "la", "der", "un"), stem_class="[a-z]+", ngrams=False, nfkc=False)
LATIN_TAGS = TagRules(
    topics=(("function words", ("of the", "in the")), ("licence", ("licensed under", "rights reserved")), ("contact", ("@", "http"))),
    compounds=(), exercise_topic="numbered", exercise_words=("version", "license"), default_topic="prose",
    content_types=(("notice", ("Version", "License")), ("negative", ("not", "nicht", "pas")), ("shout", ("!!", "***"))), numbered_type="notice", dialogue_type="dialogue", dialogue_after="negative", default_type="plain",
    terms=("tion", "the", "der", "que", "license"), number_unit=".", nfkc=False,
)
