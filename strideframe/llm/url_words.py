"""Small labelled URL table of the URL filter: general vocabulary of site names, put together by rule.

Words to block are the usual subjects of blocklists (adult, gambling, drugs sold by mail, malware, piracy, advertising and tracking,
spam, loans). Words to allow are everyday nouns of five languages, surnames and towns, and ordinary words that look like blocked ones. Sites often
have made-up names, so the beginning of one ordinary word with the end of another is allowed as well. No list was drawn up
from the hosts of any table to be judged.
"""

from __future__ import annotations

import random
import zlib

# Vocabulary by subject.
BLOCK = {
    "adult": "adult porn porno xxx sex sexy nude nudes erotic escort escorts webcam fetish hentai camgirls milf hookup playmates stripper swinger",
    "gambling": "casino poker slots roulette blackjack baccarat keno jackpot betting bets bookmaker sportsbook lottery lotto bingo wager gamble gambling",
    "drugs": "viagra cialis levitra tramadol xanax valium vicodin ambien pharma pills meds steroids painkiller dietpills",
    "malware": "malware phishing trojan spyware exploit keylogger botnet ransomware hacktool rootkit",
    "piracy": "warez crack keygen torrent torrents pirate serials nulled cracked rapidleech",
    "adverts": "ads adserver adclick adnet advert banner popunder popups tracker track tracking clicks affiliate doubleclick pixel beacon",
    "spam": "spam linkfarm clickbait backlinks spammer seofarm bulkmail massmail",
    "money": "payday loans replica forex getrich cashadvance quickcash pyramid fastmoney freemoney",
}
ALLOW = {
    "english": "news daily gazette herald tribune journal press weekly magazine radio school university college library history science physics chemistry math biology poetry novel letters museum archive garden kitchen recipes cooking baking family house furniture tools repair craft sewing river mountain forest island harbor weather ocean valley meadow birds flowers city village bridge castle station market bakery coffee theatre cinema gallery studio workshop council sports cycling running football hiking travel music books film health clinic hospital church charity software engineering consulting design architects lawyers insurance bank transport farm factory energy",
    "french": "maison jardin cuisine journal musique voyage livre ville pont marche fleur montagne riviere ecole histoire peinture theatre boulangerie fromage pain vin soleil lumiere chemin bateau plage neige enfant famille sante mairie",
    "german": "haus garten kueche zeitung musik reise buch stadt bruecke markt blume berg fluss schule geschichte malerei werkstatt baeckerei brot wein sonne licht weg boot strand schnee kinder familie gesundheit rathaus verein handwerk",
    "spanish": "casa jardin cocina diario musica viaje libro ciudad puente mercado flor montana rio escuela historia pintura teatro panaderia queso pan vino sol luz camino barco playa nieve familia salud ayuntamiento",
    "italian": "giardino cucina giornale viaggio libro citta ponte mercato fiore montagna fiume scuola storia pittura teatro forno formaggio vino sole luce strada barca spiaggia neve famiglia salute comune bottega",
    "people": "smith miller garcia dubois schneider lopez martin weber rossi johnson anderson nguyen moreau fischer hoffmann fernandez romano bianchi jensen larsen novak kowalski petrov yamada tanaka okafor mbeki silva santos costa",
    "towns": "london paris berlin madrid roma wien lisboa dublin oslo praha krakow athens chicago boston denver seattle toronto lima bogota osaka kyoto nairobi cairo delhi sydney hamburg lyon sevilla torino gent",
    "lookalikes": "essex sussex middlesex betsy alphabets tibetan pharmacology pharmacist pharmacy medieval medals adsorption roads loads beads salads heads cashmere analysis cocktails trackside racetrack soundtrack crackers firecracker bannerman pixelart spamalot slotcars pillars pillows trojanhorse explorer classic assets sextant unisex bingley loanwords",
}
BESIDE = "my the best online club world plus zone center group info hub top live first".split()
LANGUAGES, TOPS, FRONTS = ("en", "fr", "de", "es"), ("com", "net", "org"), ("", "www.", "blog.", "m.")
PATHS = {1: ("bonus", "win", "buy", "free", "deal", "click"), 0: ("about", "article", "archive", "contact", "read", "story")}


def _urls(name: str, label: int, rng: random.Random) -> list[str]:
    out = []
    for front in FRONTS:
        beside = rng.choice(BESIDE)
        host = rng.choice([name, f"{name}-{beside}", f"{beside}-{name}", f"{name}{beside}", f"{beside}{name}", f"{name}{rng.randrange(100)}"])
        last = rng.choice([str(rng.randrange(1000)), f"{rng.randrange(1000)}.html", rng.choice(PATHS[label]), ""])
        out.append(f"https://{front}{host}.{rng.choice(['example.', ''])}{rng.choice(TOPS)}/{rng.choice(LANGUAGES)}/{last}")
    return out


def made_up(rng: random.Random, words: list[str]) -> str:
    """The beginning of one ordinary word and the end of another."""
    a, b = rng.choice(words), rng.choice(words)
    return a[: rng.randrange(2, 5)] + b[-rng.randrange(2, 5) :]


def labelled(seed: int = 11, invented: int = 300) -> list[tuple[str, float, bool]]:
    """(url, 1.0 for block or 0.0, held out) rows, every fifth by hash held out; words to block have more urls than the others, which are more words."""
    rng = random.Random(seed)
    names = [(w, label) for label, groups in ((1, BLOCK), (0, ALLOW)) for words in groups.values() for w in words.split()]
    ordinary = [w for w, label in names if label == 0]
    names += [(made_up(rng, ordinary), 0) for _ in range(invented)]
    return [(u, float(label), zlib.crc32(u.encode()) % 5 == 0) for w, label in names for _ in range(3 if label else 1) for u in _urls(w, label, rng)]
