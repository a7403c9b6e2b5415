"""Small built-in word lists, their case forms by rule, and the dictionaries a user adds.

A longer list is a parameter: `Lexicon.load(folder)` reads <name>.txt files, one entry a line."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import lru_cache

# fixed values: common given names
MALE = "адам азамат айдар аким александр алексей альберт анатолий андрей антон арам аркадий арсений артём артем артур богдан борис вадим валентин валерий василий виктор виталий владимир владислав вячеслав геннадий георгий герман глеб григорий даниил денис дмитрий евгений егор иван игнат игорь ильдар илья ильяс кирилл клим константин лаврентий лев леонид лука макар максим мурат марат марк матвей мирон михаил назар никита николай олег остап павел платон прохор рамиль рашид ренат ринат родион пётр петр роман руслан семён семен сергей савелий святослав севастьян станислав степан тарас тимофей тимур фёдор федор филипп эдуард эльдар эмиль юлиан юрий яков ярослав".split()
FEMALE = "аида айгуль александра алевтина алина алиса алла алёна алена анастасия ангелина анжела анна антонина арина асия валентина валерия варвара вера вероника виктория галина гульнара гузель дарья диана дина динара ева евгения екатерина елена елизавета жанна зинаида зоя инесса инна ирина ия камила карина кира клавдия кристина ксения лариса лидия любовь людмила маргарита марина мария милана надежда наталья наталия нина оксана олеся ольга полина прасковья раиса регина римма роза светлана софия софья тамара таисия татьяна ульяна эвелина элина эльвира эльмира эмма юлия яна".split()
LATIN = "aleksandr alexander aleksei alexey anatoly andrei andrey anton artem boris denis dmitry dmitrii evgeny evgenii fedor georgy grigory igor ilya ivan kirill konstantin leonid maksim maxim mikhail nikita nikolai nikolay oleg pavel petr roman ruslan sergei sergey stanislav stepan timur viktor vladimir yuri yury anna anastasia daria elena ekaterina evgenia galina irina julia yulia ksenia larisa ludmila maria marina natalia nina oksana olga polina svetlana tatiana valentina vera viktoria john james mary robert michael william david linda elizabeth jennifer thomas daniel paul mark susan".split()
# fixed values: the most common surnames, which are reported in lower case, too, where a role introduces them
COMMON = "иванов смирнов кузнецов попов васильев петров соколов михайлов новиков фёдоров федоров морозов волков алексеев лебедев семёнов семенов егоров павлов козлов степанов николаев орлов андреев макаров никитин захаров зайцев соловьёв соловьев борисов яковлев григорьев романов воробьёв воробьев сергеев кузьмин фролов александров дмитриев королёв королев гусев киселёв киселев ильин максимов поляков сорокин виноградов ковалёв ковалев белов медведев антонов тарасов жуков баранов филиппов комаров давыдов беляев герасимов богданов осипов сидоров матвеев титов марков миронов крылов куликов карпов власов мельников денисов гаврилов тихонов казаков афанасьев данилов савельев тимофеев фомин чернов абрамов мартынов ефимов федотов щербаков назаров калинин исаев чернышев быков маслов родионов коновалов лазарев воронин климов филатов пономарёв пономарев голубев кудрявцев прохоров наумов потапов журавлёв журавлев".split()
# fixed values: well-known people, surnames last
FAMOUS = ["александр пушкин", "михаил лермонтов", "лев толстой", "фёдор достоевский", "антон чехов", "николай гоголь", "иван тургенев", "сергей есенин", "владимир маяковский", "анна ахматова", "марина цветаева", "борис пастернак", "юрий гагарин", "пётр чайковский", "дмитрий менделеев", "михаил ломоносов", "илья репин", "сергей рахманинов", "михаил булгаков", "сергей королёв", "владимир высоцкий", "александр суворов", "михаил кутузов"]
# fixed values: cities
CITIES = "москва санкт-петербург петербург новосибирск екатеринбург казань челябинск омск самара ростов-на-дону уфа красноярск воронеж пермь волгоград краснодар саратов тюмень тольятти ижевск барнаул ульяновск иркутск хабаровск ярославль владивосток махачкала томск оренбург кемерово новокузнецк рязань астрахань пенза липецк тула киров чебоксары калининград брянск курск иваново магнитогорск тверь ставрополь белгород сочи архангельск владимир калуга смоленск чита курган орёл орел вологда мурманск тамбов кострома псков сургут армавир апатиты арзамас батайск бердск березники бийск братск волжский воткинск вязьма геленджик глазов дзержинск димитровград домодедово дубна евпатория ейск елабуга елец ессентуки железногорск жуковский златоуст ишим каменск-уральский камышин канск керчь киселёвск кисловодск клин клинцы ковров комсомольск-на-амуре копейск кропоткин кстово кызыл ленинск-кузнецкий лобня магадан майкоп миасс минусинск мичуринск муром надым назрань нальчик находка невинномысск нефтекамск нефтеюганск нижневартовск нижнекамск новокуйбышевск новомосковск новороссийск новочеркасск ногинск норильск ноябрьск обнинск октябрьский орск первоуральск петрозаводск петропавловск-камчатский прокопьевск пушкино пятигорск раменское реутов рубцовск рыбинск салават салехард севастополь северодвинск симферополь соликамск стерлитамак сызрань сыктывкар таганрог тобольск туапсе ухта феодосия ханты-мансийск хасавюрт черкесск череповец шахты щёлково электросталь элиста энгельс южно-сахалинск ялта подольск химки мытищи люберцы балашиха абакан якутск грозный саранск йошкар-ола выборг гатчина коломна серпухов одинцово королёв королев зеленоград минск киев алматы астана ташкент ереван баку тбилиси бишкек душанбе".split() + ["нижний новгород", "великий новгород", "набережные челны", "нижний тагил", "старый оскол"]
COUNTRIES = "россия рф казахстан беларусь белоруссия украина армения узбекистан киргизия кыргызстан таджикистан азербайджан грузия молдова туркменистан германия франция италия испания польша турция китай индия израиль сша япония латвия литва эстония финляндия".split() + ["российская федерация", "республика беларусь", "республика казахстан"]
# common words that a name's place in a sentence may hold
STOP = frozenset("и в на не что как для или если при".split())
LEGAL = frozenset("ооо ао пао компания завод".split())

SURNAME = ("ов", "ев", "ёв", "ин", "ын", "ский", "цкий", "ской", "цкой", "ова", "ева", "ёва", "ина", "ына", "ская", "цкая", "енко", "ко", "ук", "юк", "чук", "ян", "янц", "дзе", "швили", "ия", "ых", "их", "оев", "аев")
# case endings of surnames, and what they stand for
OBLIQUE = ("ова", "ову", "овым", "ове", "овой", "еву", "ева", "евым", "еве", "евой", "ёву", "ёва", "ёвым", "ёве", "ёвой", "ину", "ина", "иным", "ине", "иной", "ского", "скому", "ским", "ском", "ской", "скую", "цкого", "цкому", "цким", "цком", "цкую")


def name_forms(name: str, female: bool) -> list[str]:
    """A given name in the six cases, by its ending."""
    if female or name.endswith(("а", "я")):
        if name.endswith("ия"):
            return [name[:-1] + e for e in ("я", "и", "ю", "ей")]
        if name.endswith("я"):
            return [name[:-1] + e for e in ("я", "и", "е", "ю", "ей")]
        if name.endswith("а"):
            return [name[:-1] + e for e in ("а", "ы", "и", "е", "у", "ой")]
        return [name] + ([name[:-1] + e for e in ("и", "ью")] if name.endswith("ь") else [])
    if name.endswith("ий"):
        return [name] + [name[:-1] + e for e in ("я", "ю", "ем", "и")]
    if name.endswith("й"):
        return [name] + [name[:-1] + e for e in ("я", "ю", "ем", "е")]
    if name.endswith("ь"):
        return [name] + [name[:-1] + e for e in ("я", "ю", "ем", "е")]
    stem = {"павел": "павл", "лев": "льв", "пётр": "петр"}.get(name, name)
    return [name] + [stem + e for e in ("а", "у", "ом", "е")]


def surname_forms(name: str) -> list[str]:
    """A surname in -ов, -ев or -ин in its cases, of men and women."""
    return [name + e for e in ("", "а", "у", "ым", "е", "ой", "ы", "ых")]


def place_forms(place: str) -> list[str]:
    """A place name in its cases, by its ending."""
    if " " in place:
        return [place]
    if place.endswith("а"):
        return [place[:-1] + e for e in ("а", "ы", "и", "е", "у", "ой")]
    if place.endswith("ия"):
        return [place[:-1] + e for e in ("я", "и", "ю", "ей")]
    if place.endswith(("ь", "й")):
        return [place] + [place[:-1] + e for e in ("и", "ью", "я", "ю", "е", "ем")]
    if place.endswith(("о", "и", "ы", "у")):
        return [place, place[:-1] + "е", place[:-1] + "а", place[:-1] + "ом", place[:-1] + "ах"]
    return [place] + [place + e for e in ("а", "у", "ом", "е")]


@dataclass(frozen=True)
class Lexicon:
    first: frozenset[str]
    latin: frozenset[str]
    surnames: frozenset[str]
    famous: frozenset[frozenset[str]]
    cities: dict[str, str] = field(hash=False)
    countries: frozenset[str]
    common: frozenset[str] = frozenset()

    @staticmethod
    @lru_cache(8)
    def of(extra: tuple[tuple[str, tuple[str, ...]], ...] = ()) -> Lexicon:
        """The built-in lists with a user's entries: first, latin, surnames, famous, cities, countries."""
        more = {k: [w.lower() for w in v] for k, v in extra}
        first = {f for n in MALE for f in name_forms(n, False)} | {f for n in FEMALE for f in name_forms(n, True)}
        first |= {f for n in more.get("first", ()) for f in name_forms(n, n.endswith(("а", "я")))}
        famous = {frozenset(p.split()) for p in FAMOUS + more.get("famous", [])}
        cities = {f: c for c in CITIES + more.get("cities", []) for f in place_forms(c)}
        countries = {f for c in COUNTRIES + more.get("countries", []) for f in place_forms(c)} | {"российской федерации", "республики беларусь", "республики казахстан"}
        return Lexicon(frozenset(first), frozenset(LATIN) | frozenset(more.get("latin", ())), frozenset(more.get("surnames", ())), frozenset(famous), cities, frozenset(countries), frozenset(f for n in COMMON for f in surname_forms(n)))


def load(folder: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """A user's word lists: the files <name>.txt of a folder, without blank lines and # comments."""
    out = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                lines = [x.split("#")[0].strip().lower() for x in f]
            out.append((name[:-4], tuple(x for x in lines if x)))
    return tuple(out)


def is_patronymic(word: str) -> bool:
    stems = ("ович", "евич", "ьич", "инич", "овн", "евн", "ичн", "иничн")
    for s in stems:
        at = word.rfind(s)
        if at > 1 and len(word) - at - len(s) <= 2:
            return True
    return word in ("оглы", "кызы")


def surname_shape(word: str) -> bool:
    """Whether a word has the ending of a surname in some case."""
    return len(word) >= 4 and word.endswith(SURNAME + OBLIQUE)


def same_stem(word: str, name: str) -> bool:
    """Whether a word is a case form of a name: they share a stem of most of the name's letters."""
    if name == "лев":
        return word in ("лев", "льв")
    n = max(3, len(name) - 2)
    return word[:n] == name[:n]
