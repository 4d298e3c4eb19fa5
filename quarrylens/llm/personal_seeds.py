"""Labelled sentences about invented people, written by hand as frames whose parts are drawn: the neutral half of what the tagger of
personal details is fitted on. Nothing here comes from a corpus."""

from __future__ import annotations

import re

import numpy as np

# fixed values: common given and family names, streets and forms of numbers, by language
_NAMES = {
    "en": ("James Mary Robert Linda Michael Susan David Karen Emma Oliver Grace Henry Ruth Peter Alice", "Smith Johnson Brown Taylor Wilson Davies Evans Walker Wright Turner Baker Clarke O'Brien Parker-Lee"),
    "de": ("Hans Anna Jürgen Ursula Karl Sabine Uwe Petra Lukas Greta Jörg Käthe", "Müller Schmidt Weber Wagner Becker Schäfer Koch Richter Wolf Groß Neumann"),
    "fr": ("Jean Marie Pierre Sophie Luc Camille Hélène Gérard Chloé André", "Martin Bernard Dubois Moreau Laurent Lefèvre Girard Roux Fournier d'Arcy"),
    "es": ("José María Carlos Lucía Javier Ana Pilar Íñigo Sofía Andrés", "García López Martínez Sánchez Pérez Gómez Ruiz Muñoz Núñez Ortega"),
    "ru": ("Иван Мария Сергей Ольга Дмитрий Анна Пётр Елена", "Петров Иванова Смирнов Кузнецова Соколов Попова Морозов Волкова"),
}
_WHOLE = {
    "ko": ["김민준", "이서연", "박지훈", "최수아", "정하은", "강도윤", "조예린", "윤시우", "남궁민", "제갈윤", "선우진", "독고영재"],
    "ja": ["田中太郎", "佐藤花子", "鈴木一郎", "高橋健", "伊藤美咲", "渡辺直樹"],
    "zh": ["王小明", "李娜", "张伟", "刘洋", "陈秀英", "赵敏", "欧阳修文"],
}
_STREETS = {
    "en": ["{n} Oak Street", "{n} Mill Lane, Flat {n1}", "{n} High Road", "{n} Queen Avenue, Apt {n1}B", "{n} Park Close"],
    "de": ["Lindenweg {n1}", "Hauptstraße {n1}a", "Am Markt {n1}", "Bergstr. {n1}"],
    "fr": ["{n1} rue de la Paix", "{n1} bis, avenue Victor Hugo", "{n1} place du Marché"],
    "es": ["Calle Mayor {n1}, 2.º B", "Avenida del Sol {n1}", "Plaza Nueva, {n1}"],
    "ko": ["세종대로 {n}", "가온로 {n1}길 {n1}", "한빛로 {n1}번길 {n}"],
    "ja": ["東京都千代田区丸の内{n1}-{n1}", "大阪市北区梅田{n1}-{n1}-{n1}"],
    "zh": ["北京路{n}号", "中山东路{n1}号{n1}室"],
    "ru": ["ул. Ленина, д. {n1}", "проспект Мира, {n1}"],
}
_PHONES = ["+44 20 #### ####", "+1 (###) ###-####", "(###) ###-####", "0#-#### ####", "+49 30 ######", "+33 6 ## ## ## ##", "+34 6## ### ###", "010-####-####", "+82 10 #### ####", "0## ### ####", "########1#", "555 ####", "+7 9## ###-##-##"]
_IDS = ["###-##-####", "AB ## ## ## C", "########K", "X#######L", "C########", "######-#######", "1 ## ## ## ### ### ##", "## ### ### ###", "M########", "###.###.###-##"]
_ID_WORDS = {"en": ["SSN", "passport no.", "national insurance number", "driving licence", "tax id"], "de": ["Ausweisnummer", "Steuer-ID", "Reisepass"], "fr": ["numéro de passeport", "numéro de sécurité sociale"], "es": ["DNI", "pasaporte", "NIE"], "ko": ["주민등록번호", "여권번호"], "ja": ["旅券番号"], "zh": ["身份证号", "护照号"], "ru": ["паспорт", "ИНН"]}
# fixed values: sentences; N name, P phone, E address of mail, A street address, I id number, W word for an id number
_FRAMES = {
    "en": ["My name is {N} and I live at {A}.", "Please call {N} on {P}.", "Contact: {N}, {E}, {P}", "The {W} of {N} is {I}.", "{W}: {I}", "Deliver it to {N}, {A}, before noon.", "Dear {N}, thank you for your letter.", "Kind regards,\n{N}\n{E}", "From: {N} <{E}>", "We spoke with {N} about the invoice.", "{N} moved to {A} last year.", "Signed by {N} ({W} {I}).", "Send a copy to {E} please.", "phone: {P}", "Dr. {N} will see you at {A}."],
    "de": ["Ich heiße {N} und wohne in der {A}.", "Bitte rufen Sie {N} unter {P} an.", "{W}: {I}", "Mit freundlichen Grüßen\n{N}", "Frau {N} erreichen Sie unter {E}.", "Die Lieferung geht an {N}, {A}."],
    "fr": ["Je m'appelle {N} et j'habite {A}.", "Appelez {N} au {P}.", "Mon {W} est le {I}.", "Cordialement,\n{N}", "Écrivez à {E}.", "Madame {N}, {A}"],
    "es": ["Me llamo {N} y vivo en {A}.", "Llame a {N} al {P}.", "{W}: {I}", "Un saludo,\n{N}", "Escriba a {E}.", "El señor {N} vive en {A}."],
    "ko": ["제 이름은 {N}입니다.", "{N} 님에게 {P}로 전화해 주세요.", "{W}: {I}", "주소는 {A} 입니다.", "{N}의 메일은 {E} 입니다."],
    "ja": ["私の名前は{N}です。", "{N}さんに{P}で電話してください。", "{W}は{I}です。", "住所は{A}です。"],
    "zh": ["我叫{N},住在{A}。", "请拨打{P}联系{N}。", "{W}:{I}", "联系人:{N} {E}"],
    "ru": ["Меня зовут {N}, я живу по адресу {A}.", "Позвоните {N} по номеру {P}.", "{W}: {I}", "С уважением,\n{N}"],
}
# fixed values: sentences without any personal detail
_PLAIN = [
    "Build {d}-{d} took {n1} minutes on port {n}.", "See ticket {n}-{n1} and commit {h}.", "The New York Release ships with Python 3.{n1}.", "git@host.example:team/app.git", "pip install tool@1.{n1}.0", "user@box:~$ ls -la", "Version 10.{n1}.{n} of the Data Platform is out.", "Run {h} ended after {n} steps.",
    "Der Neue Bericht wurde am 3.{n1}.2021 erstellt.", "La Nueva Versión tiene {n} cambios.", "Le Grand Projet compte {n} pages.", "어제 서버를 다시 시작했습니다.", "今日は会議が三つあります。", "我们明天发布新版本。", "Сборка завершилась за {n1} минут.", "@octo_dev opened pull request #{n}.", "{n} Main Branch builds are green.", "Error code {n}{n} in Module Loader.",
]
_KIND = {"N": "person_name", "P": "phone", "E": "email", "A": "address", "I": "id_number"}
_PART = re.compile(r"\{(\w)\}")


def _numbers(form: str, rng: np.random.Generator) -> str:
    form = form.replace("{n1}", str(rng.integers(1, 60))).replace("{n}", str(rng.integers(10, 2000))).replace("{d}", str(rng.integers(100, 9999))).replace("{h}", "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 10)))
    return re.sub("#", lambda _: str(rng.integers(0, 10)), form)


def _draw(part: str, lang: str, rng: np.random.Generator) -> str:
    pick = lambda xs: xs[rng.integers(len(xs))]
    if part == "N":
        if lang in _WHOLE:
            return pick(_WHOLE[lang])
        given, family = (x.split() for x in _NAMES[lang])
        name = f"{pick(given)} {pick(['van ', 'de la ', 'von ', 'al ']) if rng.random() < 0.06 else ''}{pick(family)}{' ' + pick(family) if lang == 'es' and rng.random() < 0.4 else ''}"
        return name.lower() if rng.random() < 0.15 else name
    if part == "E":
        local = pick(["j.smith", "anna99", "info.desk", "m_lee", "karl-weber", "x.y"])
        return pick([f"{local}@mail.example", f"{local}@corp.example.org", f"{local} (at) mail (dot) example", f"{local} [at] corp [dot] example"])
    if part == "W":
        return pick(_ID_WORDS[lang])
    return _numbers(pick({"P": _PHONES, "I": _IDS, "A": _STREETS[lang]}[part]), rng)


def sentences(rows: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``rows`` sentences with their labelled spans, a quarter of them without any."""
    rng = np.random.default_rng(seed)
    langs = list(_FRAMES)
    out = []
    for k in range(rows):
        if k % 4 == 3:
            out.append((_numbers(_PLAIN[rng.integers(len(_PLAIN))], rng), []))
            continue
        lang = langs[rng.integers(len(langs))] if rng.random() < 0.6 else "en"
        frame = _FRAMES[lang][rng.integers(len(_FRAMES[lang]))]
        text, spans, at = "", [], 0
        for m in _PART.finditer(frame):
            text += frame[at : m.start()]
            value = _draw(m[1], lang, rng)
            if m[1] in _KIND:
                spans.append((len(text), len(text) + len(value), _KIND[m[1]]))
            text += value
            at = m.end()
        out.append((text + frame[at:], spans))
    return out
