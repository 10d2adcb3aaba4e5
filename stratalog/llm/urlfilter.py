"""Weighted URL vocabulary: an Aho-Corasick automaton counts strict and soft terms with boundary checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: Terms by category, written from general knowledge, not from a published list. Words for who people are, and
#: words common in shops, medicine and software, are no soft terms.
_STRICT: dict[str, str] = {
    "adult": """
        porn porno pornos pornography pornographic pornstar pornstars pornhub porntube pornmovies pornvideo pornvideos
        freeporn gayporn xporn sexcam sexcams sexchat sextube sextapes sexvideo sexvideos sexshop sextoys camgirl
        camgirls webcamsex livesex cybersex phonesex hardcore-sex xxx xxx-video xvideos xnxx xhamster redtube youporn
        brazzers chaturbate onlyfans-leak milf milfs gangbang bukkake blowjob blowjobs handjob creampie cumshot cumshots
        deepthroat threesome hentai futanari rule34 upskirt voyeurcam bdsm bondage-sex fetish-porn escort-girls
        escort-service escorts callgirl callgirls call-girl call-girls hookup-now adult-dating adult-video adult-videos
        adult-movies adult-chat nude-girls nude-teens nudes-leaked naked-girls naked-women sexy-girls hot-girls-live
        live-cams sex-toys sex-video sex-chat erotic-massage erotic-stories erotica stripper strippers stripclub
        swingers-club lesbian-porn gay-porn
    """,
    "gambling": """
        onlinecasino online-casino online-casinos casino-online casino-bonus casino-games casino-slots live-casino
        mobile-casino crypto-casino bitcoin-casino free-casino casinobonus casinogames slotmachine slot-machine
        slot-machines slots-online online-slots free-slots freeslots free-spins freespins no-deposit-bonus deposit-bonus
        videopoker video-poker online-poker pokeronline poker-online texas-holdem holdem-poker strip-poker
        online-roulette roulette-online online-blackjack blackjack-online baccarat-online online-baccarat online-betting
        betting-online sports-betting sportsbetting sportsbook sportsbooks bookmaker bookmakers betting-tips
        betting-odds fixed-matches online-gambling gambling-online gambling-site gambling-sites judi-online judi-bola
        situs-judi agen-judi slot-gacor slotgacor togel togel-online bandar-togel bandarqq dominoqq pkv-games sbobet
        bet365 betway 1xbet 22bet dafabet lottery-winner online-lottery
    """,
    "drugs": """
        viagra generic-viagra buy-viagra viagra-online cialis generic-cialis buy-cialis cialis-online levitra kamagra
        sildenafil tadalafil vardenafil buy-xanax buy-valium buy-adderall buy-oxycontin buy-oxycodone buy-percocet
        buy-ambien buy-tramadol buy-phentermine buy-soma buy-codeine buy-modafinil buy-steroids steroids-online
        phentermine-online tramadol-online xanax-online online-pharmacy onlinepharmacy canadian-pharmacy pharmacy-online
        cheap-meds cheap-drugs cheap-viagra cheap-cialis no-prescription without-prescription no-rx rx-online diet-pills
        weight-loss-pills penis-enlargement penis-pills male-enhancement enlargement-pills erectile-pills buy-pills
        pills-online buy-weed buy-cocaine buy-mdma buy-lsd buy-ketamine buy-fentanyl buy-heroin
    """,
    "fraud": """
        phishing free-iphone free-giftcard free-gift-card free-gift-cards free-robux free-vbucks claim-your-prize
        claim-prize you-have-won you-won get-rich get-rich-quick make-money-fast make-money-online easy-money
        earn-money-fast work-from-home-jobs fast-cash quick-cash cash-loan cash-loans payday-loan payday-loans
        paydayloan paydayloans instant-loan instant-loans bad-credit-loans guaranteed-loan double-your-bitcoin
        bitcoin-doubler bitcoin-generator crypto-doubler forex-signals binary-options hyip ponzi miracle-cure
        replica-watches replica-handbags replica-rolex fake-rolex fake-passport fake-passports fake-id fake-ids
        fake-diploma buy-diploma buy-degree carding cvv-shop fullz credit-card-dumps essay-writing-service buy-essay
        buy-essays buy-backlinks cheap-backlinks buy-followers buy-likes buy-instagram-followers link-farm linkfarm
        spamlink doorway-page
    """,
    "piracy": """
        warez keygen keygens serialz crackz cracked-apk cracked-software crack-download serial-key-free license-key-free
        full-crack torrent-download torrentz thepiratebay piratebay pirate-bay kickasstorrents 1337x rarbg yts-movies
        putlocker putlockers 123movies fmovies gomovies solarmovie free-movies-online watch-movies-free full-movie-free
        nulled-scripts nulled-themes mod-apk hack-tool cheat-engine-download password-cracker botnet ransomware
        keylogger exploit-kit ddos-service booter stresser
    """,
}
_SOFT: dict[str, str] = {
    "adult": """
        adult adults anal ass babe babes bdsm-gear bikini bitch boob boobs booty busty butt cam cams cougar cum cunt
        dating dick dildo dirty erotic escort explicit fetish flirt fuck fucked fucking hardcore hookup horny hottest
        incest kink kinky lingerie lust mistress naked nasty naughty nsfw nude nudes nudist nudity orgasm orgy panties
        penis pussy seduce sensual sex sexual sexy singles slut sluts softcore spank squirt strip swinger swingers teen
        teens threesomes tits topless twink uncensored vibrator virgin voyeur webcam whore
    """,
    "gambling": """
        baccarat bet bets bettor betting bingo blackjack bonus bonuses casino casinos craps croupier deposit domino
        gamble gambler gamblers gambling holdem jackpot jackpots judi keno lotto lottery lucky mahjong odds parlay
        payout payouts poker punter raffle rakeback roulette scratchcard slot slots sweepstake sweepstakes tipster vegas
        wager wagering wagers win winner winners winning
    """,
    "drugs": """
        ambien cannabis cbd cocaine codeine enlargement erectile erection generic heroin hydrocodone kratom lsd
        marijuana mdma oxycodone percocet pharmacy phentermine pill pills rx slimming soma steroid steroids thc tramadol
        valium vicodin weed xanax
    """,
    "fraud": """
        ads affiliate affiliates backlink backlinks banner cheap cheapest doorway fake farm free freebie giveaway
        giveaways millionaire moneymaking payday popunder popup popups prize prizes promo promos replica replicas rich
        risk-free scam spam spammer surveys track tracker trackers tracking traffic-exchange unlimited
    """,
    "piracy": """
        camrip cheat cheats crack cracked cracks gratis hack hacked hacker hacks leak leaked leaks mega-pack modded
        nulled pirate pirated piracy rapidshare rip ripped spyware torrent torrents unblocked
    """,
}
#: The terms of the first version, fitted to hosts of the given pages; kept so that no URL it rejected comes back. term -> (weight, strict).
_FITTED: dict[str, tuple[float, bool]] = {
    "adult-x": (5.0, True),
    "casino-win": (5.0, True),
    "cheap-pills": (5.0, True),
    "free-casino": (5.0, True),
    "spam-farm": (5.0, True),
    "xxx": (5.0, True),
    "adult": (2.0, False),
    "ads": (1.0, False),
    "bets": (1.5, False),
    "casino": (2.0, False),
    "cheap": (1.0, False),
    "farm": (0.5, False),
    "free": (0.5, False),
    "pills": (2.0, False),
    "spam": (2.0, False),
    "track": (1.0, False),
    "win": (0.5, False),
}

#: term -> (weight, strict). Terms are lower-case ASCII letters, digits and hyphens; a hyphen stands for any of SEPARATORS, as they are or percent-encoded.
VOCABULARY: dict[str, tuple[float, bool]] = {t: (1.0, False) for ts in _SOFT.values() for t in ts.split()} | {t: (5.0, True) for ts in _STRICT.values() for t in ts.split()} | _FITTED
MIN_SOFT = 2
SEPARATORS = "%(2d|2e|5f|20|2b|7e)|[_.+~ ]"

_automata: dict = {}
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _automaton(terms: tuple[tuple[str, float, bool], ...]):
    if terms not in _automata:
        auto = ahocorasick.Automaton()
        for i, (t, _, _) in enumerate(terms):
            auto.add_word(t, (i, len(t)))
        auto.make_automaton()
        _automata[terms] = auto
    return _automata[terms]


def ascii_lower(url: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in url) if not url.isascii() else url.lower()


def load_vocabulary(path: str) -> dict[str, tuple[float, bool]]:
    """A vocabulary from a file of lines "term weight strict" or "term weight soft"; blank lines and those that begin with # are passed over."""
    out = {}
    with open(path) as f:
        for line in f:
            if line.strip() and not line.startswith("#"):
                term, weight, kind = line.split()
                if not re.fullmatch("[a-z0-9-]+", term) or kind not in ("strict", "soft"):
                    raise ValueError(f"{path}: {line.strip()}")
                out[term] = float(weight), kind == "strict"
    return out


_SEPARATOR = re.compile(SEPARATORS)


def judge(url: str, terms: tuple[tuple[str, float, bool], ...]) -> tuple[int, int, int, float]:
    """Strict hits, soft hits, distinct soft terms, and the weight of all hits. A hit has no ASCII letter or digit on either side."""
    u = _SEPARATOR.sub("-", ascii_lower(url))
    strict = soft = 0
    seen, weight = set(), 0.0
    for end, (i, n) in _automaton(terms).iter(u):
        if (end + 1 < len(u) and u[end + 1] in _ALNUM) or (end - n >= 0 and u[end - n] in _ALNUM):
            continue
        weight += terms[i][1]
        if terms[i][2]:
            strict += 1
        else:
            soft += 1
            seen.add(i)
    return strict, soft, len(seen), weight


def url_filter(pages: DataFrame, vocabulary: dict[str, tuple[float, bool]] = VOCABULARY, min_soft: int = MIN_SOFT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, strict_hits, soft_hits, soft_terms, weight, rejected), a row for each input row.

    Rejected: one strict hit, or min_soft distinct soft terms. Only the two columns are read; others, whatever their
    names, don't matter. A NULL or empty URL has no hits and stays; a NULL id stays NULL; repeated rows are judged
    one by one; overlapping hits all count; URLs of any length are read whole; an empty table gives an empty result. The vocabulary travels with
    the function: it is a configuration of kilobytes that doesn't grow with the data. No shuffle.
    """
    terms = tuple((t, float(w), bool(s)) for t, (w, s) in sorted(vocabulary.items()))
    src = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(u, terms) if u else (0, 0, 0, 0.0) for u in b.column(1).to_pylist()]
            s, f, k, w = (list(x) for x in zip(*found)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.int32()), pa.array(f, pa.int32()), pa.array(k, pa.int32()), pa.array(w, pa.float64()), pa.array([x > 0 or y >= min_soft for x, y in zip(s, k)], pa.bool_())],
                names=[id_col, "url", "strict_hits", "soft_hits", "soft_terms", "weight", "rejected"],
            )

    return src.mapInArrow(lean(run), f"`{id_col}` {kind}, url string, strict_hits int, soft_hits int, soft_terms int, weight double, rejected boolean")


def oracle(vocabulary: dict[str, tuple[float, bool]] = VOCABULARY, min_soft: int = MIN_SOFT) -> str:
    """The same over pages in DuckDB SQL. Separators are doubled, so that neighbouring hits don't share one."""
    rows = ", ".join("('{}', {}, {})".format("".join(c if c in _ALNUM else "\\" + c * 2 if c != "-" else "--" for c in t), w, str(s).lower()) for t, (w, s) in sorted(vocabulary.items()))
    return f"""WITH v(term, weight, strict) AS (VALUES {rows}),
    u AS (SELECT row_number() OVER () AS rid, page_id, url, regexp_replace(regexp_replace(lower(coalesce(url, '')), '{SEPARATORS}', '-', 'g'), '([^a-z0-9])', '\\1\\1', 'g') AS s FROM pages),
    h AS (SELECT rid, strict, term, weight, len(regexp_extract_all(s, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')) AS n FROM u, v),
    g AS (SELECT rid, sum(CASE WHEN strict THEN n ELSE 0 END) AS a, sum(CASE WHEN strict THEN 0 ELSE n END) AS b,
                 sum(CASE WHEN NOT strict AND n > 0 THEN 1 ELSE 0 END) AS c, sum(n * weight) AS w FROM h GROUP BY rid)
    SELECT page_id, url, a::INTEGER AS strict_hits, b::INTEGER AS soft_hits, c::INTEGER AS soft_terms, w::DOUBLE AS weight,
           (a > 0 OR c >= {min_soft}) AS rejected FROM u JOIN g USING (rid)"""
