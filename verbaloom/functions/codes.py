"""Language codes: native model labels to ISO 639-3, codes and names to languages, sizes for people.

Tables are small dimensions. The two-letter codes and languages are stated here; the registry's retirements and
macrolanguages come from its published tab files by path, with the members needed for the languages below as default.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ISO 639-1 and 639-3 codes.
PART1 = dict(
    x.split(":")
    for x in """aa:aar ab:abk ae:ave af:afr ak:aka am:amh an:arg ar:ara as:asm av:ava ay:aym az:aze ba:bak be:bel bg:bul bi:bis bm:bam
    bn:ben bo:bod br:bre bs:bos ca:cat ce:che ch:cha co:cos cr:cre cs:ces cu:chu cv:chv cy:cym da:dan de:deu dv:div dz:dzo ee:ewe el:ell
    en:eng eo:epo es:spa et:est eu:eus fa:fas ff:ful fi:fin fj:fij fo:fao fr:fra fy:fry ga:gle gd:gla gl:glg gn:grn gu:guj gv:glv ha:hau
    he:heb hi:hin ho:hmo hr:hrv ht:hat hu:hun hy:hye hz:her ia:ina id:ind ie:ile ig:ibo ii:iii ik:ipk io:ido is:isl it:ita iu:iku ja:jpn
    jv:jav ka:kat kg:kon ki:kik kj:kua kk:kaz kl:kal km:khm kn:kan ko:kor kr:kau ks:kas ku:kur kv:kom kw:cor ky:kir la:lat lb:ltz lg:lug
    li:lim ln:lin lo:lao lt:lit lu:lub lv:lav mg:mlg mh:mah mi:mri mk:mkd ml:mal mn:mon mr:mar ms:msa mt:mlt my:mya na:nau nb:nob nd:nde
    ne:nep ng:ndo nl:nld nn:nno no:nor nr:nbl nv:nav ny:nya oc:oci oj:oji om:orm or:ori os:oss pa:pan pi:pli pl:pol ps:pus pt:por qu:que
    rm:roh rn:run ro:ron ru:rus rw:kin sa:san sc:srd sd:snd se:sme sg:sag sh:hbs si:sin sk:slk sl:slv sm:smo sn:sna so:som sq:sqi sr:srp
    ss:ssw st:sot su:sun sv:swe sw:swa ta:tam te:tel tg:tgk th:tha ti:tir tk:tuk tl:tgl tn:tsn to:ton tr:tur ts:tso tt:tat tw:twi ty:tah
    ug:uig uk:ukr ur:urd uz:uzb ve:ven vi:vie vo:vol wa:wln wo:wol xh:xho yi:yid yo:yor za:zha zh:zho zu:zul""".split()
)
# Labels that models use in a sense of their own.
OVERRIDES = {"als": "gsw", "bh": "bho", "sh": "hbs", "iw": "heb", "in": "ind", "ji": "yid", "jw": "jav", "mo": "ron", "nah": "nhe", "eml": "egl"}
# Individual languages and their macrolanguages, as far as the languages below need them.
MACRO = dict(
    x.split(":")
    for x in """als:sqi aae:sqi aat:sqi aln:sqi arb:ara arz:ara ary:ara acm:ara ars:ara apc:ara ajp:ara aeb:ara acq:ara apd:ara arq:ara
    azj:aze azb:aze ayr:aym bos:hbs hrv:hbs srp:hbs cmn:zho yue:zho wuu:zho nan:zho hak:zho gan:zho hsn:zho cdo:zho dik:din ekk:est
    fuv:ful gaz:orm gug:grn kmr:kur ckb:kur knc:kau ltg:lav lvs:lav khk:mon nob:nor nno:nor npi:nep ory:ori pbt:pus pes:fas prs:fas
    plt:mlg quy:que swh:swa taq:tmh uzn:uzb ydd:yid zsm:msa ind:msa min:msa bjn:msa lus:lus""".split()
)
# Retired codes and what replaced them, as far as the languages below need them.
RETIRED = {"mol": "ron", "scc": "srp", "scr": "hrv", "tmp": "tpi", "agp": "prf", "baz": "tvu", "ggn": "gvr", "guv": "duz", "jap": "jaa", "kgh": "kml"}
# Languages by name and code.
LANGUAGES = dict(
    x.split(":")
    for x in """ACEHNESE:ace AFRIKAANS:af AKAN:ak ALBANIAN:sq AMHARIC:am ARABIC:ar ARMENIAN:hy ASSAMESE:as ASTURIAN:ast AWADHI:awa AYMARA:ay
    AZERBAIJANI:az BALINESE:ban BAMBARA:bm BANJAR:bjn BASHKIR:ba BASQUE:eu BELARUSIAN:be BEMBA:bem BENGALI:bn BHOJPURI:bho BOSNIAN:bs
    BRETON:br BUGINESE:bug BULGARIAN:bg BURMESE:my CANTONESE:yue CATALAN:ca CEBUANO:ceb CENTRAL_ATLAS_TAMAZIGHT:tzm CENTRAL_KURDISH:ckb
    CHHATTISGARHI:hne CHICHEWA:ny CHINESE:zh CHOKWE:cjk CRIMEAN_TATAR:crh CROATIAN:hr CZECH:cs DANISH:da DARI:prs DINKA:dik DUTCH:nl
    DYULA:dyu DZONGKHA:dz EGYPTIAN_ARABIC:arz ENGLISH:en ESPERANTO:eo ESTONIAN:et EWE:ee FAROESE:fo FIJIAN:fj FINNISH:fi FON:fon FRENCH:fr
    FRIULIAN:fur FULA:ff GALICIAN:gl GANDA:lg GEORGIAN:ka GERMAN:de GREEK:el GUARANI:gn GUJARATI:gu HAITIAN_CREOLE:ht HAUSA:ha HEBREW:he
    HINDI:hi HUNGARIAN:hu ICELANDIC:is IGBO:ig ILOCANO:ilo INDONESIAN:id IRISH:ga ITALIAN:it JAPANESE:ja JAVANESE:jv JINGPHO:kac
    KABIYE:kbp KABUVERDIANU:kea KABYLE:kab KAMBA:kam KANNADA:kn KANURI:kr KASHMIRI:ks KAZAKH:kk KHMER:km KIKONGO:kg KIKUYU:ki KIMBUNDU:kmb
    KINYARWANDA:rw KIRUNDI:rn KOREAN:ko KURDISH:ku KYRGYZ:ky LAO:lo LATGALIAN:ltg LATVIAN:lv LIGURIAN:lij LIMBURGISH:li LINGALA:ln
    LITHUANIAN:lt LOMBARD:lmo LUBA_KASAI:lua LUO:luo LUXEMBOURGISH:lb MACEDONIAN:mk MAGAHI:mag MAITHILI:mai MALAGASY:mg MALAY:ms
    MALAYALAM:ml MALTESE:mt MAORI:mi MARATHI:mr MEITEI:mni MESOPOTAMIAN_ARABIC:acm MINANGKABAU:min MIZO:lus MONGOLIAN:mn
    MOROCCAN_ARABIC:ary MOSSI:mos NAJDI_ARABIC:ars NEPALI:ne NORTH_LEVANTINE_ARABIC:apc NORTHERN_SOTHO:nso NORWEGIAN:no
    NORWEGIAN_NYNORSK:nn NUER:nus OCCITAN:oc ODIA:or OROMO:om PANGASINAN:pag PAPIAMENTO:pap PASHTO:ps PERSIAN:fa POLISH:pl PORTUGUESE:pt
    PUNJABI:pa QUECHUA:qu ROMANIAN:ro RUSSIAN:ru SAMOAN:sm SANGO:sg SANSKRIT:sa SANTALI:sat SARDINIAN:sc SCOTTISH_GAELIC:gd SERBIAN:sr
    SHAN:shn SHONA:sn SICILIAN:scn SILESIAN:szl SINDHI:sd SINHALA:si SLOVAK:sk SLOVENIAN:sl SOMALI:so SOUTH_AZERBAIJANI:azb
    SOUTH_LEVANTINE_ARABIC:ajp SOUTHERN_SOTHO:st SPANISH:es SUNDANESE:su SWAHILI:sw SWATI:ss SWEDISH:sv TAGALOG:tl
    TAIZZI_ADENI_ARABIC:acq TAJIK:tg TAMASHEQ:taq TAMIL:ta TATAR:tt TELUGU:te THAI:th TIBETAN:bo TIGRINYA:ti TOK_PISIN:tpi TSONGA:ts
    TSWANA:tn TUMBUKA:tum TUNISIAN_ARABIC:aeb TURKISH:tr TURKMEN:tk TWI:tw UKRAINIAN:uk UMBUNDU:umb URDU:ur UYGHUR:ug UZBEK:uz
    VENETIAN:vec VIETNAMESE:vi WARAY:war WELSH:cy WESTERN_FRISIAN:fy WOLOF:wo XHOSA:xh YIDDISH:yi YORUBA:yo ZULU:zu""".split()
)


def languages(spark: SparkSession) -> DataFrame:
    """languages(name, code, part3), the dimension of what can be translated."""
    return spark.createDataFrame([(n, c, PART1.get(c, c)) for n, c in LANGUAGES.items()], "name string, code string, part3 string")


def read_macrolanguages(spark: SparkSession, path: str) -> dict[str, str]:
    """The registry's macrolanguage tab file (M_Id, I_Id, I_Status) as individual to macro; active rows only."""
    rows = spark.read.csv(path, sep="\t", header=True).where("I_Status = 'A'").select("I_Id", "M_Id").collect()
    return {r.I_Id: r.M_Id for r in rows}


def read_retirements(spark: SparkSession, path: str) -> dict[str, str]:
    """The registry's retirement tab file (Id, Change_To) as old to new; splits have no single successor and are left out."""
    rows = spark.read.csv(path, sep="\t", header=True).where("Change_To IS NOT NULL").select("Id", "Change_To").collect()
    return {r.Id: r.Change_To for r in rows}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def to_iso639_3(label: Column, *, collapse: bool = False, retired: dict[str, str] = RETIRED, macro: dict[str, str] = MACRO) -> Column:
    """__label__en, eng_Latn, zh-Latn, EN and the like to an ISO 639-3 code; unknown codes stay as they are."""
    code = F.lower(F.split(F.regexp_replace(label, "^__label__", ""), "[-_]")[0])
    code = F.coalesce(_lookup(OVERRIDES, code), F.when(F.length(code) == 2, _lookup(PART1, code)), code)
    code = F.coalesce(_lookup(retired, code), code)
    return F.coalesce(_lookup(macro, code), code) if collapse else code


def normalize_label(label: Column, *, normalize: bool = True, collapse: bool = False) -> Column:
    return to_iso639_3(label, collapse=collapse) if normalize else F.regexp_replace(label, "^__label__", "")


def decode_compact(label: Column) -> Column:
    """Six letters hold a family and a language, of which the last three count; else the first three do."""
    return F.when(F.length(label) == 6, F.substring(label, 4, 3)).otherwise(F.substring(label, 1, 3))


def to_language(value: Column, default: Column | None = None, *, retired: dict[str, str] = RETIRED, macro: dict[str, str] = MACRO) -> Column:
    """A name, code or tag to a language's code: by name, by its own code, by ISO 639-3, by its macrolanguage; else the default."""
    value = F.trim(value)
    by_part3 = {PART1.get(c, c): c for c in LANGUAGES.values()}
    part1 = PART1 | {k: v for k, v in OVERRIDES.items() if len(k) == 2}
    name = _lookup(LANGUAGES, F.upper(F.regexp_replace(value, r"[\s-]+", "_")))
    code = F.split(F.lower(value), "[-_]")[0]
    own = _lookup({c: c for c in LANGUAGES.values()}, code)
    part3 = F.when(F.length(code) == 2, _lookup(part1, code)).otherwise(code)
    part3 = F.coalesce(_lookup(retired, part3), part3)
    found = F.coalesce(name, own, _lookup(by_part3, part3), _lookup(by_part3, _lookup(macro, part3)))
    return found if default is None else F.coalesce(found, default)


def human_size(size: Column) -> Column:
    """0 MB, one decimal up to 10 MiB, whole MB up to 1 GiB, then GB with one decimal."""
    mb, gb = float(1 << 20), float(1 << 30)
    return F.when(size == 0, F.lit("0 MB")).when(size >= gb, F.format_string("%.1f GB", size / gb)).when(size >= 10 * mb, F.format_string("%.0f MB", size / mb)).otherwise(F.format_string("%.1f MB", size / mb))
