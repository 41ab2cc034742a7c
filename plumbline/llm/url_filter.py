"""Allow or block web addresses: rules by host and path, and a classifier for all others.

The classifier is a logistic regression on hashed character n-grams of host and
path, trained on a small labelled table of addresses
(BLOCK and ALLOW).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

#: Host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Rules are an array in the plan; a table of more of them must be joined instead.
MOST_RULES = 10_000

SPACE, GRAMS, PASSES, STEP, DECAY = 1 << 16, (2, 3, 4, 5), 1000, 8.0, 1e-5

#: The labelled table, written by hand: whole addresses to block and to allow; most names are invented, half of them under reserved ones.
BLOCK = """
http://www.lucky-casino-royal.example.com/en/bonus/welcome?aff=1182
https://spin247.casino-palace.net/slots/free-spins
http://online-casino-guide.example.org/en/best-bonus
https://poker-stars-cash.org/de/432
http://bet-and-win-big.example.com/odds/football/live
https://m.betking365.net/live-betting
http://blackjack-roulette.example.com/fr/play-now
https://slots-vegas777.com/register?ref=banner
http://bingo-jackpots.example.org/claim
https://casino.gamble-zone.org/es/tragaperras
http://cheap-pills-online.example.com/order/viagra
https://rx-pharmacy-discount.net/no-prescription
http://www.buy-cheap-meds.example.org/en/cialis-generic
https://diet-pills-fast.net/lose-weight-now
http://pills-without-doctor.example.org/tramadol
https://cheap-meds24.com/de/2076
http://miracle-weightloss.example.net/offer?id=7
https://generic-viagra-store.com/fr/acheter
http://male-enhance-pills.example.org/fr/try-free
https://steroids-shop-eu.net/buy
http://adult-videos-hd.example.com/watch/hot
https://www.xxx-tube-free.net/es/2898
http://adult.dating-hot.example.org/singles-near-you
https://live-sex-cams.org/room/4471
http://xxx-movies-clips.org/videos/free
https://sexy-cams.net/hot/live
http://hot-xxx-girls.example.com/en/video
http://nude-pics-gallery.example.com/en/page/12
https://adult-chat-rooms.com/join
http://escorts-in-town.example.net/profiles
https://porn-stream.org/de/3720
http://milf-dates.example.com/signup
https://adultshop-toys.org/sale
http://spam-mailer-pro.example.com/fr/bulk/send
https://seo-link-farm.net/buy-backlinks
http://www.link-farm-directory.example.org/submit-url-free
https://spamfarm.com/es/4542
http://spam-comments-bot.example.net/download
https://content-farm-articles.net/rewrite/spin
http://autoblog-farm.example.com/en/tag/cheap-insurance
https://buy-followers-fast.com/instagram/10000
http://bulk-email-list.example.org/2-million-addresses
https://article-spinner-seo.com/de/5364
http://free-iphone-winner.example.com/claim-prize?u=88
https://you-won-giftcard.net/survey/start
http://prize-center-claim.example.com/fr/congratulations
https://win-a-car-today.net/enter
http://paypa1-secure-login.example.com/verify/account
https://appleid.verify-account-support.net/es/6186
http://bank0famerica-alert.example.org/update-password
https://secure-login-netflix.org/billing/confirm
http://account-suspended-help.example.com/en/unlock
https://dhl-parcel-fee.net/pay?track=55012
http://wallet-connect-airdrop.example.net/claim
https://bitcoin-doubler-x2.com/de/7008
http://crypto-millionaire-robot.example.org/start-trading
https://forex-signals-profit.org/join-vip
http://earn-money-from-home.example.com/fr/500-a-day
https://payday-loans-instant.com/apply/bad-credit
http://debt-gone-now.example.net/quick-loan
https://fast-cash-advance.org/es/7830
http://replica-watches-luxury.example.com/rolex
https://cheap-handbags-outlet.net/louis-sale
http://fake-diploma-service.example.org/en/order
https://essay-writers-cheap.net/buy-essay
http://cracked-software-keys.example.com/keygen/download
https://warez-full-version.net/de/8652
http://serial-number-free.example.org/activate
https://torrent-movies-hd.org/download/new
http://xxx-rated-downloads.com/hot
https://cam-girls-xxx.org/hot/videos
http://free-download-codec.example.com/fr/setup.exe
https://flash-player-update.net/install.exe
http://pc-cleaner-virus-alert.example.com/scan
https://your-computer-infected.org/es/9474
http://driver-update-tool.example.net/get?src=popup
https://click-track-ads.com/redirect?to=offer
http://popunder-network.example.net/en/serve/ad?z=912
https://adserver-banners.org/impression?id=3
http://toolbar-install-free.example.com/thanks
https://proxy-unblock-sites.net/de/10296
http://hack-facebook-password.example.com/tool
https://game-cheats-generator.org/free-gems
http://vbucks-generator-free.example.net/fr/human-verification
https://horoscope-love-spell.net/psychic-reading
http://miracle-cure-doctors-hate.example.com/secret
https://timeshare-exit-now.org/es/11118
http://cheap-cigarettes-online.example.net/cart
https://vape-discount-sale.org/deal
http://mega-lottery-results.example.com/en/winning-numbers
https://sweepstakes-daily.com/enter-now
http://hot-russian-brides.example.net/catalog
https://webcam-girls-live.org/de/11940
http://domain-parking-ads.example.com/search?q=loans
https://xn--oogle-wmc.com/login
""".split()
ALLOW = """
https://www.uni-tuebingen.de/en/faculties/medicine
http://library.edu/catalog/1831
https://museum-of-nature.org/exhibitions/fossils
http://www.cityhall.gov/permits/parking
https://journal.science-letters.org/articles/2021/04
http://news.dailyherald.co.uk/2019/05/12/local
https://weather.example.com/forecast/10-days
http://opendata.org/datasets/rivers.csv
https://archive.example.net/texts/1887/letters
http://health.gov/vaccines/schedule
https://cooking.example.com/recipes/lentil-soup
http://gardenersforum.net/threads/tomatoes.4412
https://travel.example.org/guides/lisbon
http://musicschool.com/lessons/violin
https://docs.example.dev/guide/install
http://encyclopedia.org/wiki/Photosynthesis
https://district12.k12.example.us/calendar
http://nationalpark.gov/trails/map
https://radio.example.fm/program/evening
http://bookreviews.com/novels/2020
https://m.rathaus-neustadt.de/de/buergerservice
http://www.bibliotheque-lyon.fr/fr/collections
https://ayuntamiento.example.es/es/tramites
http://gazette.fr/fr/article/8831
https://blog.marthasgarden.com/2018/07/roses
http://mathforum.org/questions/771
https://code.example.io/project/issues/54
http://lists.net/archive/2004-March
https://shop.woolandyarn.com/en/products/needles
http://www.bakery-anders.de/de/brot
https://theatre.example.org/season/tickets
http://hospital.org/departments/radiology
https://birdwatchers.example.net/sightings/heron
http://history.edu/courses/medieval
https://railway.example.com/timetable/north
http://chess.org/openings/sicilian
https://astro.example.edu/telescope/images
http://farmersmarket.com/vendors
https://poetry.example.net/authors/rilke
http://genealogy.org/families/hansen
https://www.thornfield-hotel.com/en/rooms
http://statistics.gov/tables/population
https://linguistics.example.edu/papers/vowels.pdf
http://sailing-club.org/regatta
http://film-archive.org/videos/1931
https://volcano-cams.net/live
http://school-girls-choir.example.com/en/video
https://climbing.example.net/routes/alps
http://insurance.com/en/contact
https://parliament.example.gov/debates/441
http://court.gov/decisions/2016
https://film.example.org/festival/program
http://rated-restaurants.com/lisbon
https://girls-football-club.org/videos
http://orchestra.com/concerts
https://rentheran.example.com/en/412
http://ingthere.net/de/77
https://m.ouenleau.example.org/fr/903
http://www.derschein.com/de/120
https://losquenca.example.net/es/31
http://ndthwhere.org/en/6
https://tionsthe.example.com/en/558
http://quelaio.net/fr/249
https://unterge.example.org/de/815
http://cionesta.com/es/640
https://theredin.example.net/en/19#top
http://eauxpar.org/fr/372?page=2
https://www.houreng.example.com/en/94?ref=x
http://m.schewald.net/de/506
https://adoraquel.example.org/es/288
http://erthandst.com/fr/61
https://standwhen.example.net/en/740
http://mentoure.org/fr/155
https://ichunder.example.com/de/999
http://delcasan.net/es/420
https://software.example.com/download/release-notes
http://en.example.org/about/staff
https://physics.example.edu/people/faculty
http://www.example.org/index.html
https://example.com/en/help/faq
http://example.net/contact
https://blog.example.com/posts/42
http://support.net/articles/reset-password
https://accounts.example.org/help/two-factor
http://bank.com/branches/oslo
https://pharmacy-school.example.edu/admissions
http://adult-education.org/courses/spanish
https://farm.example.com/visit/apples
http://dairyfarm-museum.org/history
https://games.example.org/rules/bridge
http://crypto-lectures.edu/notes/rsa
https://lottery-history.example.org/essay
http://loans.library.org/renew
https://watchmakers.example.net/repairs
http://traffic.gov/road-works
""".split()


def _split(address: str) -> tuple[str, str]:
    """Host and path of an address of the table, as `parts` has them."""
    rest = address.partition("://")[2].partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def labelled_table() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block or 0 to allow)."""
    return [(*_split(x), label) for own, label in ((BLOCK, 1), (ALLOW, 0)) for x in own]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for a null address and one without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null. Of equally long ones the first of the table fits."""
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for an array in the plan")
    ordered = sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, F.lit(0))


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path, each with its ends marked."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % SPACE for i in range(max(1, len(text) - n + 1)))
    return np.array(sorted(found), dtype=np.int64)


def train(table: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; equal input gives an equal model. An empty table: all zero."""
    weights, bias = np.zeros(SPACE), 0.0
    if not table:
        return weights, bias
    rows = [features(h, p) for h, p, _ in table]
    scale = np.array([1 / math.sqrt(len(r)) for r in rows])
    of, at = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    truth = np.array([y for _, _, y in table], dtype=float)
    for _ in range(PASSES):
        p = 1 / (1 + np.exp(-(np.bincount(of, weights[at], len(rows)) * scale + bias)))
        miss = (truth - p) / len(rows)
        weights += STEP * (np.bincount(at, (miss * scale)[of], SPACE) - DECAY * weights)
        bias += STEP * miss.sum()
    return weights, bias


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, table: list[tuple[str, str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is the probability to block by the classifier.

    A rule fits its host and all subdomains; the longest wins over others and
    over the classifier. Null addresses and such without :// have empty host and
    path, fit no rule and are judged by the classifier like any other. Repeated
    rows stay; other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    weights, bias = train(labelled_table() if table is None else table)
    model = spark.sparkContext.broadcast((weights.astype(np.float32), bias))
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            out = []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = features(h, p)
                out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, float(w[at].sum()) / math.sqrt(len(at)) + b)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], ["page_id", "host", "path", "score"])

    scored = rows.mapInArrow(score, "page_id long, host string, path string, score double")
    fit = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    scored = scored.withColumn("__fit", fit)
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", F.col("__fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op7_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
