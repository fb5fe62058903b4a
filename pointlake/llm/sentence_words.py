"""Words that tell how a mark or a gap is meant, by role and language. All are compared case-folded."""

# Abbreviations that a sentence does not end with: titles, and words that need what follows them.
NEVER_LAST = {
    "en": "wash calif mass mr mrs ms messrs dr prof st rev hon gen col capt lt sgt maj gov sen rep pres supt mt ft approx esp incl excl vs cf viz e.g i.e eg ie temp ed eds trans max min avg dept est ca resp cp",
    "de": "hr fr frl dr prof dipl ing st ca bzw vgl inkl exkl zzgl lt max min evtl ggf z.b d.h z.hd u.u i.d.r o.g s.o s.u fa sog str geb verh abs hd resp bes tel gem einschl",
    "fr": "m mm mme mmes mlle mlles dr pr me mgr st ste env max min cf c.-à-d p.ex ex av bd boul tél réf resp",
    "es": "sr sra srta sres dr dra d dña prof profa ing lic arq gral aprox máx mín max min cf p.ej ej av avda c tel ref vs núm s.a.r",
    "ru": "проф акад доц г-н г-жа гр им ул пр просп пер пл наб обл р-н пос дер макс мин ок прибл ср см напр т.е т.к т.н т.о англ нем рус",
    "el": "κ κα κος δρ καθ αγ π.χ δηλ βλ πρβλ περ αρ οδ λεωφ",
    "ar": "د أ م أ.د ص ج ق.م",
    "hi": "डॉ श्री श्रीमती सुश्री प्रो मि मी मि.मी से.मी कि.मी कि.ग्रा सं पं रु",
    "th": "มม ซม กม กก ดร นพ พญ ศ ผศ รศ พ.ศ ค.ศ น เบอร์ ต.ค ม.ค ก.พ",
}
# Abbreviations before a number.
BEFORE_NUMBER = {
    "en": "no nos nr ver mk p pp sect sects para paras eqn app ed fig figs vol vols ch sec art par eq tab pt op jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "nr s bd kap abb tab z jan feb mär apr jun jul aug sep sept okt nov dez",
    "fr": "n no p pp fig vol chap art janv févr avr juil sept oct nov déc",
    "es": "n núm pág págs p pp fig vol cap art ene feb mar abr jun jul ago sep sept oct nov dic",
    "ru": "стр с рис табл гл п пп т д кв корп стр янв фев мар апр июн июл авг сен сент окт ноя дек",
    "el": "σ σελ εικ αρ τ",
}
# Abbreviations that stand inside a sentence and may as well be its last word.
MAYBE_LAST = {
    "en": "inc ltd co corp llc bros jr sr phd m.d b.a m.a a.m p.m am pm u.s u.k u.n e.u d.c a.d b.c al hrs hr yrs yr mins secs min sec in ft lb lbs oz kg km cm mm wk wks mo mos ave blvd rd sq",
    "de": "gmbh ag co kg std min sek tsd mio mrd jh jhd o.k u.a u.ä u.v.m m.e",
    "fr": "h min sec s.a s.a.s cie ltd inc apr j.-c",
    "es": "s.a s.l ee.uu ff.cc rr.hh cía ltda inc min seg h u hnos",
    "ru": "г гг руб коп р тыс млн млрд мин сек ч час кг км м см мм шт чел в вв н.э",
    "el": "μ.μ π.μ χιλ εκ μ.χ",
    "th": "น",
}
# Abbreviations that close a list.
CLOSES_LIST = "etc usw etc.p u.s.w и.т.д т.д т.п и.т.п др пр κ.λπ κλπ κ.ά κ.τ.λ κτλ u.dgl etcétera"
# Words after which a number with a point is an ordinal.
BEFORE_ORDINAL = "der die das den dem des am im vom zum zur beim ab bis seit jeder jede jedes jeden ein eine einem einer ihr ihre sein seine mein meine dieser diese dieses diesem diesen und oder"
# Words that no sentence ends with: articles, prepositions and the like.
TIED = {
    "en": "the a an of to in on at for with and or my our your his her its their this that these those by from as than into over under between about",
    "de": "der die das den dem des ein eine einen einem einer eines ohne für von vom zum zur in im am bei seit und oder aber mein meine meinen unser unsere ihr ihre sein seine zwischen gegen als wie frau herr herrn lt",
    "fr": "le la les un une des de du à au aux en dans sur sous pour par avec sans et ou mon ma mes notre nos votre vos son sa ses ce cet cette ces que qui",
    "es": "el la los las un una unos unas de del a al en con sin por para y e o u mi mis su sus nuestro nuestra que",
    "ru": "в на с со из у к ко по за и а но или от до для без при о об под над не",
    "el": "ο η το οι τα του της των τον την ένα μια και με σε στο στη για από",
    "hi": "का की के को में से पर और या जो कि यह वह",
    "ar": "في من على إلى عن مع هذا هذه و أو",
}
# Function words that open sentences, for texts whose letter case tells nothing; the corpus adds its own.
OPENS = {
    "en": "the a an i it he she we you they this that these those my our his her their your there here what who when where why how if even every everyone everybody nobody somebody two three after before since at on in for would could should did does do is are was were don't not never all some no one dr mrs mr as use and but so over during within while because although however then now",
    "de": "der die das ein eine einer ich er sie es wir ihr man mein meine unser unsere dieser diese dieses auch am im in nach seit für vor bei mit ohne auf warum wie was wer wo wann würde zwei drei alles selbst herr frau naja so",
    "fr": "le la les l' un une des je j'ai il elle on nous vous ils elles ce cette ces mon ma mes notre même pourquoi comment quand où qui peut-on toute tout depuis pendant après avant dans cet m mme si",
    "es": "el la los las un una yo lo mi mis nuestro nuestra su este esta esto ni hasta ya no con cuando donde por para desde durante después antes en me se",
    "ru": "я он она мы вы они это этот эта здесь там наш наша даже уже всем после до с в на через почему как кто когда где никто не проф г-н ну",
    "el": "ο η το οι τα ένας μια εγώ αυτός αυτή αυτό θα δεν γιατί πώς πού πότε",
}
# Words that carry a sentence on after speech or a pause.
CARRIES_ON = "and or but nor then und oder aber denn sondern dann et ou mais puis donc car y e o u pero luego и а но или да потом затем και ή αλλά μετά ثم و أو لكن और या लेकिन फिर तो ที่ และ หรือ แต่ เพราะ ก็ ซึ่ง literally casi"
# Verbs and phrases of saying that follow speech.
SAYS = "said asked says asks replied answered shouted whispered sighed laughed cried told wrote sagte fragte meinte rief antwortete seufzte schrieb lachte flüsterte dit demandé s'est a soupiré demanda répondit cria murmura dijo preguntó suspiró respondió gritó exclamó contestó comentó сказал сказала спросил спросила вздохнул вздохнула ответил ответила крикнул είπε ρώτησε απάντησε φώναξε قال قالت سأل سألت ضحك कहा पूछा बोला बोली"
# Thai: particles that end a sentence.
THAI_FINAL = "ครับ ค่ะ คะ ครับผม นะครับ นะคะ นะค่ะ จ้ะ จ้า จ๊ะ ฮะ ฮ่ะ ขอรับ เจ้าค่ะ"
# Thai words beside them, for the word lattice.
THAI_WORDS = "และ หรือ แต่ เพราะ ก็ ว่า ที่ ซึ่ง โดย กับ ของ ใน จาก ถ้า เมื่อ เลย แล้ว ไป มา มาก ดี อยู่ ยัง ไม่ มี ใช้ ได้ ให้ เป็น จะ ซื้อ อีก แน่นอน บอก คน ทำไม ใคร อะไร เร็ว ส่ง ปัญหา ราคา บาท วัน สัปดาห์ เดือน ปี นะ น่ะ สิ ซิ ละ ล่ะ หรอก จริง ตาม"
# Thai: words that open a statement, and words that close one without a particle.
THAI_OPENS = "ผม ฉัน ดิฉัน เรา เขา เธอ มัน พวกเขา นี่ นั่น วันนี้ เมื่อวาน ตอนนี้ แต่ว่า อย่างไรก็ตาม ดังนั้น นอกจากนี้"
THAI_CLOSES = "แล้ว เลย มาก ด้วย จริงๆ อีกครั้ง ทันที เท่านั้น นะ"
# Chinese and Japanese: words that open a sentence.
CJK_OPENS = "我 我们 你 你们 他 她 它 他们 这 这个 那 那个 但是 不过 所以 而且 另外 如果 虽然 今天 昨天 总之 私 彼 彼女 これ それ あれ この その でも しかし だから ただ また さらに もし 今日 昨日"
# Chinese and Japanese: words before a pause that cannot end a sentence.
CJK_BEFORE = "以后 之后 以前 之前 的时候 如果 因为 虽然 但是 而且 可是 于是 然后 和 与 的 把 被 在 是 对 从 到 たら なら れば ので から けど けれど が し て で と は を に へ も の たり ながら"
# Chinese and Japanese: words that end sentences.
CJK_FINAL = "了 吗 呢 吧 啊 呀 嘛 哦 です ます ました ません でした だ である だった ない なかった か ね よ な わ さ た る"
# Japanese: particles that tie what follows speech to the sentence.
CJK_AFTER_SPEECH = "と って という といった としか とは とも とか など の を が は に で も"


def words(*groups: str | dict[str, str]) -> frozenset[str]:
    """All words of the groups."""
    return frozenset(w.casefold() for g in groups for line in (g.values() if isinstance(g, dict) else [g]) for w in line.split())
