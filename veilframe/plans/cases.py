"""Sentences of our own with the personal data in them marked, as [CATEGORY|value]; {k} stands for six digits.

Each family has sentences of every branch of its detectors: shapes, case forms, cues on either side, and
sentences that look alike and hold nothing."""

from __future__ import annotations

import re

MARK = re.compile(r"\[([A-Z_]+)\|([^\]]*)\]")

FAMILIES: dict[str, tuple[list[str], list[str]]] = {
    "passport": (
        ["PASSPORT", "PASSPORT_ISSUER", "PASSPORT_ISSUE_DATE", "SUBDIVISION_CODE"],
        [
            "Мой паспорт [PASSPORT|4511 {k}], выдан [PASSPORT_ISSUER|ОМВД России по городу Туле]",
            "Паспорт безопасности объекта 4511 {k} утверждён",
            "Паспорт изделия 4511 {k} потерян",
            "Паспорт [PASSPORT|4509 {k}] выдан [PASSPORT_ISSUER|ОВД района Измайлово] [PASSPORT_ISSUE_DATE|20.06.2010], код подразделения [SUBDIVISION_CODE|770-001]",
            "Паспорт: серия [PASSPORT|45 10] номер [PASSPORT|{k}]",
            "В паспорте [PASSPORT|46 05 {k}] нет отметки о браке",
            "Паспортные данные клиента: [PASSPORT|4611-{k}], дата выдачи [PASSPORT_ISSUE_DATE|3 марта 2012]",
            "Кем выдан: [PASSPORT_ISSUER|УФМС России по Тверской области], к/п [SUBDIVISION_CODE|690-002], дело {k}",
            "Паспорт выдан [PASSPORT_ISSUE_DATE|14.07.2011] [PASSPORT_ISSUER|Отделом внутренних дел города Клина], заявка {k}",
            "passport [PASSPORT|4500 {k}]",
            "Номер [PASSPORT|4512 {k}], код подразделения [SUBDIVISION_CODE|690-011]",
            "Паспорт сделки 4509 {k} закрыт",
            "Заказ 4509 {k} доставлен",
            "Отдел полиции сообщил о проверке {k}",
        ],
    ),
    "names": (
        ["FIO"],
        [
            "Директор [FIO|Орлова Марина Викторовна] подписала приказ {k}",
            "Меня зовут [FIO|Сергей Андреевич Белов], заявка {k}",
            "Письмо от [FIO|Соколова Д. И.], номер {k}",
            "Пациентка [FIO|Фёдорова Нина Олеговна], карта {k}",
            "Заявитель [FIO|Волков], обращение {k}",
            "Получатель [FIO|Волков], перевод {k}",
            "Отправитель [FIO|Волков], перевод {k}",
            "Владелец счёта [FIO|Волков], запрос {k}",
            "Плательщик [FIO|Волков], квитанция {k}",
            "Поэт Сергей Есенин, том {k}",
            "Писатель Антон Чехов, том {k}",
            "Имени Антона Чехова названа школа {k}",
            "ПАО Волков сообщило о прибыли {k}",
            "АО Волков сообщило о прибыли {k}",
            "Компания Волков сообщила о прибыли {k}",
            "Проспект Гагарина перекрыт, сообщение {k}",
            "Роман Льва Толстого вышел тиражом {k}",
            "Завод Морозов выпустил {k} деталей",
            "Клиент [FIO|Смирнов Иван Петрович] оформил заявку {k}",
            "Договор {k} подписала [FIO|Ольга Игоревна Кузнецова]",
            "Доверенность {k} на имя [FIO|Волкова Петра Сергеевича]",
            "Получатель: [FIO|Морозов А.В.], сумма {k}",
            "Заявка {k} от [FIO|И. П. Лебедева]",
            "ФИО: [FIO|Захарова Мария], анкета {k}",
            "Позвоните [FIO|Алексею Павловичу] по заявке {k}",
            "Заёмщик [FIO|Никитин] внёс {k} рублей",
            "Клиент [FIO|иванов] обратился по вопросу {k}",
            "Счёт {k} открыт на имя [FIO|петровой анны сергеевны]",
            "Стихи Александра Пушкина читали {k} раз",
            "ООО Кузнецов поставило {k} единиц",
            "Владелец счетов получил {k} рублей",
            "Улица маршала Жукова, заявка {k}",
        ],
    ),
    "dates": (
        ["BIRTH_DATE", "PASSPORT_ISSUE_DATE"],
        [
            "Заказ {k} от 05.04.2023 собран на складе",
            "Счёт {k} выставлен 11.02.2022",
            "Сборка 12.10.2021 прошла проверку {k}",
            "Отпуск с 01.07.2024, приказ {k}",
            "Встреча 14 мая в 15:30, комната {k}",
            "Мой день рождения [BIRTH_DATE|12.05.90], анкета {k}",
            "Дата рождения: [BIRTH_DATE|7 марта], анкета {k}",
            "Дата рождения мужа [BIRTH_DATE|01.02.1980], жены [BIRTH_DATE|03.04.1982], заявка {k}",
            "Она родилась [BIRTH_DATE|9 января 1961] года в семье врача, лист {k}",
            "Паспорт получен, дата выдачи [PASSPORT_ISSUE_DATE|01.02.2019], лист {k}",
            "Клиент {k}, д.р. [BIRTH_DATE|04.05.1988]",
            "Рождён [BIRTH_DATE|17.08.1979], карточка {k}",
            "Рождена [BIRTH_DATE|17.08.1979], карточка {k}",
            "г.р. [BIRTH_DATE|17.08.1979], карточка {k}",
            "Паспорт выдан [PASSPORT_ISSUE_DATE|17.08.2009], карточка {k}",
            "Справка выдана [PASSPORT_ISSUE_DATE|17.08.2009], карточка {k}",
            "dob [BIRTH_DATE|12.05.1990], file {k}",
            "Клиент родился, договор {k} от 12.05.2020",
            "Рождение ребёнка и заявка {k} от 12.05.2020",
            "date of birth [BIRTH_DATE|1990-05-12], file {k}",
            "Дата рождения: [BIRTH_DATE|12.05.1990], договор {k} от 01.02.2024",
            "Клиент {k} родился [BIRTH_DATE|3 марта 1985] года",
            "Родилась [BIRTH_DATE|21091978], анкета {k}",
            "Анкета {k}: [BIRTH_DATE|1990-05-12] года рождения",
            "Сотрудник {k}, [BIRTH_DATE|1974] г.р.",
            "Дата рождения клиента [BIRTH_DATE|двадцать первое мая тысяча девятьсот семьдесят пятого], заявка {k}",
            "Документ {k} выдан [PASSPORT_ISSUE_DATE|14/07/2011]",
            "дата выдачи - [PASSPORT_ISSUE_DATE|5 июня 2015], дело {k}",
            "born [BIRTH_DATE|12.05.1990], file {k}",
            "Родители: дата рождения [BIRTH_DATE|02.03.1960], заявка {k}",
            "Договор {k} от 12.05.2020 продлён",
            "Версия 10.12.2020 сборки {k}",
            "Платёж {k} от 03.04.2021, срок до 05.06.2022",
            "Скидка 12.05 процента по заказу {k}",
        ],
    ),
    "address": (
        ["CITY", "STREET", "HOUSE", "APARTMENT", "POSTAL_CODE", "COUNTRY", "ADDRESS"],
        [
            "Живу в городе [CITY|Тула], улица [STREET|Лесная], дом [HOUSE|8], квартира [APARTMENT|15], заявка {k}",
            "Прошу доставить: г. [CITY|Пенза], ул. [STREET|Мира], д. [HOUSE|10], заказ {k}",
            "Магазин на улице Мира, дом 3 открыт, чек {k}",
            "Адрес банка: г. Тверь, ул. Садовая, д. 7, лист {k}",
            "Проживаю в городе [CITY|Омск], дом [HOUSE|5], анкета {k}",
            "Доставка на улицу [STREET|Новую], дом [HOUSE|5], анкета {k}",
            "Прописан по адресу: улица [STREET|Лесная], дом [HOUSE|5], анкета {k}",
            "Место жительства: улица [STREET|Лесная], дом [HOUSE|5], анкета {k}",
            "Зарегистрирован: улица [STREET|Лесная], дом [HOUSE|5], анкета {k}",
            "Склад на улице Лесной, дом 5, анкета {k}",
            "Филиал находится на улице Лесной, дом 5, анкета {k}",
            "Банкомат стоит на улице Лесной, дом 5, анкета {k}",
            "Страна проживания: [COUNTRY|Россия], г. [CITY|Казань], анкета {k}",
            "Мой адрес: [CITY|Калуга], [STREET|Садовая], [HOUSE|4], заявка {k}",
            "Проживает по адресу: г. [CITY|Тверь], ул. [STREET|Садовая], д. [HOUSE|7], кв. [APARTMENT|12], заявка {k}",
            "Адрес: [POSTAL_CODE|170100], г. [CITY|Тверь], проспект [STREET|Победы], дом [HOUSE|14], заявка {k}",
            "Клиент {k} живёт в [CITY|Рязани]",
            "Доставка: [CITY|Москва], [STREET|Лесная], [HOUSE|5]-[APARTMENT|12], заказ {k}",
            "Зарегистрирована в [CITY|Калужской] области, г. [CITY|Обнинск], ул. [STREET|Мира], [HOUSE|3], заявка {k}",
            "Прописан: село [CITY|Покровское], улица [STREET|Новая], дом [HOUSE|1], дело {k}",
            "место жительства: г. [CITY|Сочи], пер. [STREET|Зелёный], д. [HOUSE|4], корп. [HOUSE|2], кв. [APARTMENT|9], анкета {k}",
            "Отделение банка: г. Тверь, ул. Садовая, д. 7, номер {k}",
            "Наш офис находится на улице Ленина, дом 5, вход {k}",
            "Филиал на проспекте Мира, 10 принял заявку {k}",
            "Курс доллара вырос, заявка {k}",
        ],
    ),
    "documents": (
        ["DRIVER_LICENSE", "OMS_POLICY", "SNILS", "FOREIGN_PASSPORT", "MILITARY_ID", "BIRTH_CERTIFICATE", "RESIDENCE_PERMIT"],
        [
            "Водительское удостоверение [DRIVER_LICENSE|77 12 {k}], полис ОМС [OMS_POLICY|7700 0000 1234 5678]",
            "В/у [DRIVER_LICENSE|7712 {k}]",
            "Права серия [DRIVER_LICENSE|77 12] номер [DRIVER_LICENSE|{k}]",
            "Номер водительского удостоверения [DRIVER_LICENSE|77 АВ {k}]",
            "[DRIVER_LICENSE|99 20 {k}] - водительское удостоверение клиента",
            "Полис медицинского страхования [OMS_POLICY|1234567890123456], дело {k}",
            "Заграничный паспорт [FOREIGN_PASSPORT|72 7{k}]",
            "Водительское удостоверение [DRIVER_LICENSE|4509 {k}], паспорта нет",
            "Водительский договор: заказ 77 12 {k}",
            "Дело 7712 {k} передано",
            "Перечислено по 7{k} рублей за проживание",
        ],
    ),
    "secrets": (
        ["CARD_NUMBER", "CVV", "PIN"],
        [
            "Карта [CARD_NUMBER|4111 1111 1111 1111], CVV [CVV|123], заявка {k}",
            "Оплата картой [CARD_NUMBER|5555555555554444] по заказу {k}",
            "[CARD_NUMBER|3782 822463 10005] - карта amex, заказ {k}",
            "Номер карты: [CARD_NUMBER|4111 1111 1111 1112], заказ {k}",
            "Код безопасности: [CVV|987], заявка {k}",
            "На обороте карты [CVV|321] - защитный код, заявка {k}",
            "Секретный код [PIN|5937] никому не говорите, заявка {k}",
            "Заказ 1234 5678 9012 3456 и номер {k}",
            "Для сим-карты pin 4821, заявка {k}",
            "Всего 123 заявки и {k} рублей",
        ],
    ),
    "account": (
        ["BANK_ACCOUNT"],
        [
            "Счёт [BANK_ACCOUNT|40817810099910{k}] открыт",
            "Расчётный счёт [BANK_ACCOUNT|40702 810 0 9991 0{k}]",
            "Переведите на р/с [BANK_ACCOUNT|40817810099910{k}] сегодня",
            "Лицевому счёту [BANK_ACCOUNT|40817.810.0.9991.0{k}] начислены проценты",
            "Штрихкод 40817810099910{k} прочитан",
            "Счёт 4081781 закрыт, заявка {k}",
        ],
    ),
    "holder": (
        ["CARD_HOLDER"],
        [
            "На карте написано [CARD_HOLDER|ANNA BELOVA], держатель, лист {k}",
            "DEAR CUSTOMER, YOUR ORDER {k} IS READY",
            "VISA PLATINUM, code {k}",
            "MASTERCARD WORLD ELITE, code {k}",
            "BANK OF MOSCOW, code {k}",
            "HAPPY NEW YEAR, code {k}",
            "Держатель карты [CARD_HOLDER|IVAN SMIRNOV], заявка {k}",
            "Card holder: [CARD_HOLDER|JOHN P. MILLER], order {k}",
            "CARDHOLDER [CARD_HOLDER|MARIA KOVALENKO] VALID THRU 12/27, {k}",
            "4111 1111 1111 1111 [CARD_HOLDER|OLEG VOLKOV] и заявка {k}",
            "Платёжная система VISA GOLD CARD, заявка {k}",
            "The report of SMITH AND SONS, page {k}",
        ],
    ),
    "citizenship": (
        ["CITIZENSHIP", "BIRTH_PLACE"],
        [
            "Гражданка [CITIZENSHIP|России], анкета {k}",
            "Место рождения: [BIRTH_PLACE|деревня Ольховка], дело {k}",
            "Гражданство: [CITIZENSHIP|Российская Федерация], место рождения: [BIRTH_PLACE|г. Калуга], заявка {k}",
            "Гражданин [CITIZENSHIP|Республики Беларусь], заявка {k}",
            "Имеет [CITIZENSHIP|украинское] гражданство, заявка {k}",
            "citizenship: [CITIZENSHIP|USA], file {k}",
            "Родился в [BIRTH_PLACE|городе Рязань], заявка {k}",
            "Уроженка [BIRTH_PLACE|села Покровское Тульской области], дело {k}",
            "Гражданство меняют редко, заявка {k}",
            "Александр Пушкин, место рождения: Москва, страница {k}",
        ],
    ),
    "inn": (
        ["INN"],
        [
            "ИНН [INN|500100732259], заявка {k}",
            "Налогоплательщик: ИНН [INN|5001 0073 2259], дело {k}",
            "Номер налогоплательщика [INN|770708389310], запись {k}",
            "Заявка {k}, число [INN|500100732259] проверено",
            "ИНН организации 7707083893, запись {k}",
            "ООО «Ромашка», ИНН 7707083893, дело {k}",
            "Код 500100732258 не подходит, запись {k}",
        ],
    ),
    "snils": (
        ["SNILS"],
        [
            "СНИЛС [SNILS|112-233-445 95], заявка {k}",
            "Страховой номер [SNILS|11223344595] и заявка {k}",
            "Число [SNILS|112 233 445 95] в анкете {k}",
            "СНИЛСа [SNILS|112-233-445 96] нет в базе {k}",
            "Число 112-233-445 96 в анкете {k}",
            "Число 11223344596 в поле {k}",
        ],
    ),
    "military_id": (
        ["MILITARY_ID"],
        [
            "Военный билет [MILITARY_ID|АК 7{k}]",
            "По военному билету [MILITARY_ID|АН№ 7{k}] снят с учёта",
            "В военнике [MILITARY_ID|АС7{k}] есть отметка",
            "Военный билет не выдан, по 7{k}",
            "Партия АК 7{k} отгружена",
        ],
    ),
    "birth_certificate": (
        ["BIRTH_CERTIFICATE"],
        [
            "Свидетельство о рождении [BIRTH_CERTIFICATE|II-МЮ {k}]",
            "[BIRTH_CERTIFICATE|XIV-АБ № {k}] выдано в загсе",
            "Свидетельства о рождении [BIRTH_CERTIFICATE|IV-БА№{k}] хранятся в деле",
            "Раздел IIII-АБ {k} отменён",
            "Глава II, страница {k}",
        ],
    ),
    "foreign_passport": (
        ["FOREIGN_PASSPORT"],
        [
            "Загранпаспорт [FOREIGN_PASSPORT|72 7{k}]",
            "Заграничного паспорта [FOREIGN_PASSPORT|72] № [FOREIGN_PASSPORT|7{k}] не было",
            "foreign passport [FOREIGN_PASSPORT|75 1{k}]",
            "Загранпаспорт готов. Заказ 72 7{k}",
            "Телефон 72 7{k}",
        ],
    ),
    "residence_permit": (
        ["RESIDENCE_PERMIT"],
        [
            "Вид на жительство [RESIDENCE_PERMIT|8{k}]",
            "ВНЖ номер [RESIDENCE_PERMIT|82{k}]",
            "Разрешение на временное проживание [RESIDENCE_PERMIT|821{k}]",
            "За временное проживание 7{k} рублей",
            "ВНЖ получен; дело 8{k}",
        ],
    ),
    "phone": (
        ["PHONE"],
        [
            "Звонить [PHONE|8 916 555-44-33], заявка {k}",
            "Тел.: [PHONE|+7 (495) 555-44-33], заявка {k}",
            "Мобильный [PHONE|916 555 44 33], анкета {k}",
            "[PHONE|(495) 555-44-33] - мой номер по заявке {k}",
            "whatsapp [PHONE|+44 20 7946 0958], file {k}",
            "Перезвоните на [PHONE|79165554433] о заявке {k}",
            "Горячая линия 8 800 555-35-35, заявка {k}",
            "Служба 112 приняла вызов {k}",
            "Адрес узла 192.168.10.25, порт {k}",
        ],
    ),
    "pin": (
        ["PIN"],
        [
            "Мой пин-код [PIN|4821], заявка {k}",
            "ПИН [PIN|482193] введён трижды, случай {k}",
            "pin code [PIN|4821] file {k}",
            "Кода карты [PIN|5937] не знаю, заявка {k}",
            "Домофон: пин 4821, квартира {k}",
            "В 2021 году было {k} заявок",
        ],
    ),
    "iban": (
        ["BANK_ACCOUNT"],
        [
            "IBAN [BANK_ACCOUNT|DE89370400440532013000], заявка {k}",
            "Перевод на [BANK_ACCOUNT|GB82 WEST 1234 5698 7654 32] по заявке {k}",
            "account [BANK_ACCOUNT|DE89 3704 0044 0532 0130 01], file {k}",
            "Артикул DE89370400440532013001, партия {k}",
        ],
    ),
    "role_mailbox": (
        ["EMAIL"],
        [
            "Пишите на info@shop.example.ru, заявка {k}",
            "Почта [EMAIL|ivan.{k}@post.example.ru] подтверждена",
            "Адрес [EMAIL|Olga_K+bank@почта.рф], анкета {k}",
            "support+{k}@example.com отвечает быстро",
            "Банк: user{k}@mail.sberbank.ru",
            "Собака @ не адрес, {k}",
        ],
    ),
}


def plain(sentence: str) -> str:
    """The sentence without its marks."""
    return MARK.sub(r"\2", sentence)


def categories(sentence: str) -> list[str]:
    """The categories that a sentence holds, each once, in order."""
    return list(dict.fromkeys(m[1] for m in MARK.finditer(sentence)))


def pieces(sentence: str) -> list[tuple[str, str]]:
    """(category or "", text) of a sentence's pieces, in order."""
    out, at = [], 0
    for m in MARK.finditer(sentence):
        out += [("", sentence[at : m.start()]), (m[1], m[2])]
        at = m.end()
    return [(c, t) for c, t in [*out, ("", sentence[at:])] if t]
