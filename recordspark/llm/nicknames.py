"""Given names with their short forms, the nickname table of the name operators."""

from __future__ import annotations

from functools import lru_cache

# Given name, then its short forms and written abbreviations.
TABLE = """
abigail abby abbie gail; adrian ade; albert al bert bertie; alexandra alex sasha sandra lexie; anthony tony ant; bartholomew bart; beatrice bea trixie bee; benjamin ben benj benny; bernadette bernie detta;
bridget biddy bridie; cedric ced; charlotte lottie charlie chas; christopher chris kit topher; clarence clar; constance connie con; daniel dan danny; deborah deb debbie debs; desmond des; dorothea dot dora dottie thea; douglas doug;
edmund ed ned eddie; edward ed eddie ted ned edw; eleanor nell ellie nora; elizabeth liz beth betty eliza eliz lizzie; evangeline eva evie; felicia fliss; fiona fi; florence flo florrie; francis frank; frederick fred freddie fredk;
gabriel gabe; geraldine gerry geri; gideon gid; gordon gordy; gregory greg; hannah han; harriet hattie; helena nell lena; henrietta etta hettie; humphrey humph; ignatius iggy nat; imogen immy; ingrid inga;
isabelle izzy bella belle; isidore izzy; jacqueline jackie; james jim jimmy jamie jas; jeremiah jerry; jonathan jon jonny; josephine jo josie; katherine kate kathy kit kath; kenneth ken kenny; kimberly kim; kristina kris tina;
lawrence larry; leonard len lenny; leopold leo; lorraine lori; louise lou; margaret maggie meg peggy margt; marjorie madge marge; matthew matt; maurice mo morrie; michael mike mick mickey; nadine nan; nathaniel nate nat nathl;
nicholas nick nicky; norbert bert norb; octavia tavy; olivia liv livvy; ophelia phelia; oswald oz ozzie; patrick pat paddy; penelope penny nell pen; philippa pip pippa; priscilla cilla prissy; quentin quen; raymond ray;
rebecca becky bec; reginald reg reggie; robert bob rob bert robt; rosalind roz ros; samantha sam sammy saml; stephen steve; susannah sue susie sukie; sylvester sly syl; tabitha tabby; theodora thea dora; thomas tom tommy thos;
timothy tim timmy; ulrich uli; ursula ursie; valentina val tina; veronica ronnie vera; vincent vin vinnie vince; walter walt wally; wilhelmina mina billie; william will bill billy liam wm; winifred winnie freda; yvonne evie; zachary zach zack;
george geo; john jack jno johnny; richard rick dick rich; charles chas charlie; joseph joe jos; mary molly polly; susan sue; andrew andy drew; david dave davy; peter pete; henry harry hal; samuel sam saml; alexander alex sandy
"""

TITLES = frozenset("mr mrs ms miss mme mlle dr prof professor capt captain sir lady lord rev hon sgt lt col maj madam judge justice señor señora herr frau monsieur madame".split())


@lru_cache(maxsize=1)
def formal_names() -> dict[str, frozenset[str]]:
    """Every given name or short form with the full names it may stand for."""
    out: dict[str, set[str]] = {}
    for row in TABLE.split(";"):
        full, *short = row.split()
        for x in (full, *short):
            out.setdefault(x, set()).add(full)
    return {k: frozenset(v) for k, v in out.items()}
