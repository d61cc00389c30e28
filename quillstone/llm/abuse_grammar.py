"""Training text for the abuse model: a grammar that builds remarks which insult, threaten, wish harm, demean or proposition
out of single words, in the three languages of the corpus, and harmless text that uses the same words. Rules are put
together from everyday words rather than whole sentences, so that the network learns what goes with what. Words are
spelled out here because the model must recognise them."""

from __future__ import annotations

import random
import re

# fixed values: vocabulary of abuse and of the harmless text around it; <x> is a rule, | parts alternatives
RULES = {
    "en": {
        "noun": "idiot|moron|cretin|imbecile|bastard|dickhead|arsehole|asshole|jackass|dumbass|scumbag|wanker|whore|slut|bitch|twat|prick|cunt|loser|retard|pig|clown|scum|dipshit|shithead|douchebag|fool|coward|liar|rat|snake|freak|creep|pervert|maggot|leech|tosser|faggot|nutjob|psycho|motherfucker|fucker|son of a bitch|piece of <muck>|waste of <waste>|sack of <muck>|pile of <muck>",
        "muck": "shit|crap|garbage|trash|dirt|filth", "waste": "space|air|oxygen|skin|time",
        "adj": "stupid|dumb|ugly|fat|filthy|pathetic|worthless|disgusting|brainless|useless|ignorant|illiterate|spineless|moronic|idiotic|retarded|smelly|bloody|fucking|goddamn|damn|shitty|lazy|lying|dirty|rotten|miserable|braindead|clueless|fucking <adj>|little|sick|total|complete|absolute|drooling|greasy|bald|crooked|half-witted",
        "trait": "stupid|dumb|ugly|brainless|pathetic|disgusting|worthless|retarded|useless|fucking <trait>|an embarrassment|mental|insane|thick|full of shit|full of crap|too stupid to <skill>|not even able to <skill>|as dumb as a <lump>|dumber than a <lump>",
        "skill": "spell|read|count|think|breathe|tie a shoe|use a keyboard|write a sentence|find a brain", "lump": "rock|brick|post|potato|slug|shoe|goldfish|doorknob",
        "job": "mayor|teacher|admin|king|coach|boss|doctor|author|headmaster|singer|bishop|minister|editor|president|guy", "kin": "mother|mum|father|sister|wife|brother|dad|family",
        "one": "<name>|<name>|<user>|this guy|that <job>|the <job> of <place>|your <kin>|the author|he|she|<name> from <place>|whoever made this|my <job>|this <job>|our <job>",
        "many": "you people|you all|you guys|all of you|these editors|the admins|everyone in <place>|people from <place>|they all|the staff here|you lot",
        "shut": "shut up|fuck off|piss off|get lost|go away|get out|shut your mouth|shut your face|go to hell|eat shit|kiss my ass|suck it|screw you|fuck you|bite me|get a life|get bent|stop crying|crawl back to your hole|learn to <skill>|stop editing|stop posting|leave this site",
        "insult": "<one> is a <noun>|<one> is a <adj> <noun>|<one> is such a <noun>|<one> is <trait>|<one> is <trait>, what a <noun>|you are a <noun>|you are a <adj> <noun>|you are <trait>|you're a <noun> <user>|you're <trait>|u r a <noun>|you <noun>|you <adj> <noun>|<user> you <noun>|<user>, you <adj> <noun>|<noun>|<adj> <noun>|<noun> <noun> <noun>|<many> are <noun>s|<many> are <adj> <noun>s|<many> are <trait>|<shut> <user>|<shut> you <noun>|<shut> you <adj> <noun>|<shut> <noun>|<shut> <noun>, <many> hate you|fuck <one>|fuck <name> and fuck <place>|fuck this|what a <noun>|what a <adj> <noun> <one> is|only a <noun> would <act>|only a <adj> <noun> would <act>|<one> must be a <noun> to <act>|some <noun> <acted>|a <adj> <noun> <acted>|which <noun> <acted>|<one> has <nobrain>|you have <nobrain>|<one> looks like a <noun>|<one> smells like <muck>|everybody hates you|everyone hates <one>|no one likes you <noun>|nobody wants you here <noun>|<one> <suck>|you <suckyou> <user>|your <kin> is a <noun>|your <kin> should have <abort>|<one> was born <bornas>|i hate <one>, what a <noun>|<one> can go to hell|<one> can <shut>|i piss on <one>|i spit on <one>",
        "suck": "sucks|sucks ass|sucks balls|is shit|is crap|eats shit|is dead to me, the <noun>|stinks|makes me puke", "suckyou": "suck|suck ass|stink|disgust me|make me puke|are shit",
        "act": "write this|believe this|believe that shit|edit this|think so|post this crap|read this|like <one>", "acted": "wrote this|edited this|made this page|deleted my page|reverted me|did this|is in charge here",
        "nobrain": "no brain|the brain of a <lump>|shit for brains|the iq of a <lump>|the face of a <noun>|the manners of a pig|less sense than a <lump>", "abort": "aborted you|flushed you down the toilet|drowned you at birth|thrown you away|swallowed", "bornas": "stupid|in a sewer|by mistake|without a brain|ugly",
        "me": "i|we|i|somebody|someone|my friends|my brother", "will": "will|am going to|are going to|gonna|shall|swear i will|want to|would love to",
        "harm": "kill|murder|strangle|stab|shoot|beat|beat up|smash|crush|burn|drown|hang|gut|choke|destroy|hunt down|cripple|hurt|cut|break|slap|bury|poison|rape|torture|break the legs of|cut the throat of|smash the face of|set fire to|run over|put a bullet in|beat the shit out of|cut off the head of",
        "prey": "you|you|<user>|<name>|you <noun>|your family|your kids|your <kin>|<one>|you and your <kin>|every one of you|you all", "when": "|||tonight|soon|tomorrow|in your sleep|when you are alone|one day|for this|with my bare hands|after school|if you do it again|with a knife|like a dog|at home",
        "self": "kill yourself|hang yourself|shoot yourself|drown yourself|burn yourself|end your life|slit your wrists|stop living|die|die already|die in a fire|drop dead|rot in hell|burn in hell|jump off a <high>|jump under a train|drink <poison>|swallow <poison>|take a bath with a toaster|lie down on the tracks|dig your own grave",
        "high": "bridge|roof|cliff|tower|building|ledge", "poison": "poison|bleach|acid|rat poison|petrol|antifreeze",
        "dies": "dies|dies slowly|dies alone|rots|rots in hell|chokes|gets cancer|gets hit by a <truck>|gets run over|burns|burns to death|drowns|never wakes up|suffers|bleeds to death|gets shot|gets stabbed|falls off a <high>|loses everything|breaks every bone", "die": "die|die slowly|die alone|rot|rot in hell|choke|get cancer|get hit by a <truck>|get run over|burn|burn to death|drown|never wake up|suffer|bleed to death|get shot|fall off a <high>|lose your legs|break your neck|catch the plague", "truck": "truck|bus|train|car|tram",
        "hope": "i hope|i wish|i pray|let's hope|hopefully|i really hope|may god make sure|we all hope|it would be great if|can't wait until",
        "done": "shot|hanged|stabbed|beaten|burned alive|drowned|killed|whipped|beheaded|put down|locked up and left to die|stoned|tortured|castrated|thrown off a <high>|fed to the dogs|buried alive",
        "threat": "<me> <will> <harm> <prey> <when>|i'll <harm> <prey> <when>|<me> will come to your <home> and <harm> you|<me> know your <home>, <user>, <me> will <harm> you|<me> found your <home>, be afraid|wait until <me> <harm> you|you are dead <when>|you are so dead <user>|you're a dead man <user>|watch out <user>, <me> will <harm> you|better run <user>, <me> <will> <harm> you|say goodbye to your <kin>|your <kin> will cry when you are dead|your <home> will burn|count your days <user>|your days are over <user>|you won't live long <user>|you will bleed <when>|you will suffer <when>|you will regret this when <me> <harm> your <kin>|next time <me> see you <me> will <harm> you|there will be blood|i have a gun and your address|nobody will find your body|you will end up in a <grave>|<one> will end up in a <grave>|<user> will not wake up tomorrow",
        "home": "house|home|door|address|flat|school|street|car", "grave": "grave|coffin|box|ditch|hole|river|wheelchair|body bag",
        "wish": "<hope> <one> <dies>|<hope> you <die>|<hope> <many> <die>|<hope> your <kin> <dies>|<hope> somebody will <harm> <prey>|<self> <user>|go and <self>|go <self>|please <self>|just <self> <noun>|why don't you <self>|you should <self>|do us a favour and <self>|do the world a favour, <self>|<one> should <self>|<one> should be <done>|<many> should be <done>|somebody should <harm> <one>|someone ought to <harm> <one>|please someone <harm> <one>|<one> deserves to be <done>|<one> deserves to die|you deserve to be <done>|you deserve to die|you deserve a bullet|the world would be better without <one>|the world would be better without you|nobody would cry if you were dead|no one will miss you when you are dead|i will dance on your grave|i will laugh when <one> <dies>|too bad <one> is still alive|what a pity you survived|you should never have been born|die <user> die|die you <noun>|i want <one> dead|i want you dead",
        "dehum": "animals|rats|vermin|cockroaches|parasites|filth|scum|criminals|thieves|liars|savages|subhuman|inferior|a plague|a disease|dirt|garbage|trash|dogs|pigs|murderers|rapists|apes|primitive|stupid animals|dirty pigs|lazy thieves|filthy scum|not human|no humans|monkeys|insects|lice|a cancer|bloodsuckers|barbarians|stinking dogs|backward|a lower race|born criminals",
        "gone": "exterminated|eradicated|wiped out|gassed|shot|deported|expelled|locked up|sterilised|driven out|thrown out|drowned|burned|hunted down|put down|enslaved|kicked out|removed from this earth|put in camps|kept in cages|banned from <where>|beaten out of <where>|sent back|killed, all of them", "drive": "exterminate|eradicate|wipe out|gas|shoot|deport|expel|lock up|sterilise|drive out|throw out|kick out|get rid of|burn|hunt down|kill|ban|send back|ship off|clean <where> of", "where": "our country|our land|<place>|our town|europe|our streets|our schools|here|this city",
        "crowd": "<folk>|<folk>|<folk>|<folk> people|<folk> immigrants|<folk> women|<folk> men|these <folk>|the <folk>|those <folk>|the <folk>|every <folk>|all <folk>|all these <folk> people|foreigners|immigrants|refugees|the jews|the muslims|the gypsies|blacks|gays",
        "vice": "steal|steal everything|lie|stink|breed like rabbits|multiply like vermin|live in filth|eat garbage|bring disease|spread disease|rape and steal|ruin everything|poison our children|cannot be trusted|have no brains|have no culture|live like animals|only want our money|smell worse than pigs|make me vomit|cheat honest people|infest <where>|pollute <where>|have no place among humans|don't belong in <where>",
        "hate": "<crowd> are <dehum>|<crowd> are <dehum> and should be <gone>|<crowd> are nothing but <dehum>|all <folk> are <dehum>|the <folk> are just <dehum>|<folk> are <dehum>|<crowd> should be <gone>|<crowd> must be <gone>|<crowd> need to be <gone>|we should <drive> <crowd>|we must <drive> the <folk>|time to <drive> <crowd>|<drive> <crowd>|<drive> them all, the <folk>|<drive> all <folk>|<crowd> <vice>|all <folk> <vice>|the <folk> <vice>|<folk> <vice>, <drive> them|a <folk> is not a human being|a <folk> is worth less than a dog|the only good <folk> is a dead one|death to the <folk>|death to all <folk>|kill the <folk>|i hate <crowd>|i hate all <folk>|everyone hates the <folk>, they <vice>|never <deal> a <folk>|don't <deal> a <folk>, they <vice>|no <folk> should <right>|no <folk> deserves to <right>|keep the <folk> out of <where>|<folk> out of <where>|<folk> go home|go back to your country <folk>|go home you <folk> <dehum>|<where> was better without the <folk>|<place> was fine before the <folk> came|<place> was clean until the <folk> invaded it|since the <folk> came <where> is full of <dehum>|too bad they did not kill more <folk>|the <folk> got what they deserved|history was right about the <folk>|somebody should finish the <folk> off|one <folk> less is a good thing|<folk> blood is dirty|dirty <folk>|fucking <folk>|filthy <folk> <dehum>|smelly <folk> <dehum>",
        "deal": "trust|hire|marry|feed|help|believe|let in|shake hands with|rent to|buy from", "right": "vote|breathe|live here|live|have children|go to school with our kids|be free|own a house|walk our streets|exist|be called a citizen",
        "part": "cock|dick|pussy|tits|boobs|ass|balls|cum|penis|nipples|butt|cunt|asshole|clit", "size": "big|tiny|huge|wet|hard|small|hairy|tight|juicy|fat|naked|massive|sweaty|perfect|thick",
        "do": "fuck|suck|lick|bang|screw|blow|ride|shag|spank|finger|cum on|sleep with|undress|jerk off|wank|swallow|fist|hump|masturbate with|have anal with|have sex with|grab the <part> of|touch the <part> of|see the <part> of", "does": "fucks|sucks|licks|bangs|screws|blows|rides|shags|swallows|takes it from|sleeps with|has sex with|jerks off|masturbates|does anal with|gets naked for|spreads for",
        "girls": "girls|women|teens|milfs|sluts|whores|boys|babes|chicks|wives|housewives|escorts", "hot": "hot|horny|naked|nude|sexy|wet|dirty|topless|slutty|busty|kinky", "pics": "pics|photos|videos|pictures|porn|movies|webcam|nudes|sex tape",
        "sex": "i want to <do> <name>|i want to <do> you|i would <do> <name> all night|i'd <do> <name>|let me <do> you|let me <do> your <part>|can i <do> you <user>|<name> wants to <do> me|<name> loves to <do> <name>|<name> loves <part>|<name> loves <size> <part>|<name> likes it up the <part>|<name> <does> everyone in <place>|<name> <does> <name>|<name> <does> dogs|<name> <does> for money|<name> has a <size> <part>|<name> has <size> <size> <part>|<name> takes <part> in the <part>|show me your <part>|show <part> <user>|send me <pics> of your <part>|send nudes <user>|my <part> is <size>|my <size> <part> in your <part>|suck my <part>|suck my <size> <part> <user>|lick my <part>|ride my <part>|<hot> <pics> of <name>|<hot> <girls> in <place>|<hot> <girls> want <part>|<hot> <girls> want to <do> you|free <hot> <pics> here|free porn, <hot> <girls>|free sex <pics> with <girls>|watch <name> <do> <name>|watch <hot> <girls> <do> <part>|call me for sex|text me for a <hot> night|looking for <hot> <girls> to <do>|looking for sex in <place>|who wants to <do> me|<hot> and wet for you|cum in my <part>|cum on my face|i came all over this|i masturbate to <name>|i got hard when i saw <name>|my <part> gets <size> when i read this|<name> was caught naked with the <job>|<name> gives <size> blowjobs|blowjobs from <name>|<name> is good in bed|<name> paid for sex with the <job>|<girls> <do> <part> for cash|bend over <user>|spread your legs <user>|take off your clothes <name>|sex sex sex|<part> <part> <part>|<name> rapes <girls>|<name> touches little boys",
        "abuse": "<insult>|<insult>|<threat>|<wish>|<hate>|<hate>|<sex>",
    },
    "de": {
        "noun": "Idiot|Vollidiot|Vollpfosten|Wichser|Hurensohn|Schlampe|Missgeburt|Arschloch|Trottel|Depp|Spast|Hure|Schwein|Drecksau|Penner|Bastard|Fotze|Arsch|Versager|Lügner|Schwachkopf|Dummkopf|Hund|Ratte|Drecksack|Spinner|Schwuchtel|Nazischwein|Mistkerl|Saftsack|Volltrottel|Hackfresse",
        "adj": "dumme|blöde|hässliche|fette|dreckige|verfickte|verdammte|widerliche|elende|miese|wertlose|hirnlose|kranke|faule|stinkende|verlogene|bescheuerte",
        "trait": "dumm|blöd|hässlich|hirnlos|krank im Kopf|widerlich|bescheuert|zu dumm zum <skill>|eine Schande|ein Witz|dumm wie Brot|wertlos|behindert", "skill": "Lesen|Denken|Schreiben|Zählen|Atmen",
        "one": "<name>|<name>|<user>|dieser Typ|der Bürgermeister|dein Vater|deine Mutter|der Autor|er|der Lehrer|der Admin|mein Chef|unser Lehrer",
        "many": "ihr alle|die Leute hier|alle Admins|diese Autoren|die in <place>|jeder von euch", "shut": "halt die Klappe|halt die Fresse|halt das Maul|verpiss dich|hau ab|fick dich|leck mich|geh weg|verschwinde|friss Scheiße|zieh Leine|geh kacken",
        "insult": "<one> ist ein <noun>|<one> ist eine <noun>|<one> ist <trait>|<one> ist so ein <adj>r <noun>|du bist ein <noun>|du bist <trait>|du bist echt <trait> <user>|du <noun>|du <adj>r <noun>|du <adj>s <noun>|<noun>|<adj>r <noun>|<noun> <noun> <noun>|<many> sind <noun>e|<many> sind <trait>|<shut>|<shut> <user>|<shut> du <noun>|<shut> du <adj>s <noun>|was für ein <noun>|so ein <noun>|welcher <noun> hat das verzapft|nur ein <noun> glaubt das|fick <name>|scheiß auf <name>|<name> hat kein Hirn|du hast kein Hirn|<one> stinkt|<one> kann mich mal|alle hassen dich|keiner mag dich <noun>|<one> ist das Letzte|dich hätte man abtreiben sollen",
        "harm": "umbringen|töten|erschießen|verprügeln|abstechen|aufhängen|erwürgen|anzünden|kaputtmachen|zerquetschen|begraben|totschlagen|fertigmachen|vergiften", "prey": "dich|euch|<name>|dich und deine Familie|deine Kinder|dich du <noun>|euch alle", "when": "||bald|heute Nacht|morgen|irgendwann|dafür|nach der Schule",
        "done": "erschossen|aufgehängt|erschlagen|verbrannt|ersäuft|umgebracht|ausgepeitscht|eingesperrt|geschlagen|gefoltert", "self": "bring dich um|stirb|stirb endlich|verrecke|häng dich auf|spring von der Brücke|spring vom Dach|erschieß dich|fahr zur Hölle|schneid dir die Adern auf|trink Gift|krepier|leg dich auf die Gleise",
        "dies": "stirbt|verreckt|krepiert|bekommt Krebs|verbrennt|ersäuft|leidet|erstickt|bricht sich den Hals|wacht nie mehr auf", "hope": "ich hoffe|hoffentlich|wir alle hoffen|ich wünsche mir,",
        "threat": "ich werde <prey> <harm> <when>|wir werden <prey> <harm> <when>|ich will <prey> <harm>|ich komme zu dir und mache dich kalt|wir finden dich und dann bist du tot|du bist tot <user>|du bist so gut wie tot|du wirst bluten <user>|du wirst leiden <when>|dein Haus wird brennen|ich habe deine Adresse und ein Messer|deine Tage sind gezählt|wir kommen dich holen|warte nur <user>, ich mache dich kaputt|beim nächsten Mal breche ich dir die Knochen|ich schlage dir die Zähne ein|man wird dich nie finden",
        "wish": "<hope> <name> <dies>|<hope> du <dies>|<self> <user>|<self> du <noun>|<self>|bitte <self>|<name> soll sterben|<name> soll verrecken|<name> gehört <done>|<many> gehören <done>|du gehörst <done>|man müsste <name> <harm>|jemand sollte <prey> <harm>|ohne dich wäre die Welt besser|keiner weint, wenn du tot bist|schade, dass <name> noch lebt|ich will <name> tot sehen|du hast den Tod verdient|ich tanze auf deinem Grab",
        "dehum": "Tiere|Ratten|Ungeziefer|Parasiten|Abschaum|Dreck|Verbrecher|Diebe|Untermenschen|Pack|Gesindel|Schweine|Affen|Lügner|Müll|eine Plage|Wilde|Bestien|keine Menschen|dreckige Hunde|Schmarotzer", "gone": "ausgerottet|vernichtet|abgeschoben|vergast|erschossen|vertrieben|eingesperrt|rausgeworfen|ausgewiesen|verbrannt|ertränkt|weggesperrt|totgeschlagen|beseitigt", "where": "unserem Land|Deutschland|<place>|unserer Stadt|Europa|unseren Schulen",
        "crowd": "die <folk>|alle <folk>|diese <folk>|die ganzen <folk>|<folk>|Ausländer|die Juden|die Zigeuner|alle Flüchtlinge", "vice": "stehlen alles|klauen|lügen|stinken|leben im Dreck|leben wie Tiere|sind faul|bringen Krankheiten|vermehren sich wie Karnickel|wollen nur unser Geld|haben keine Kultur|vergiften unsere Kinder|haben hier nichts verloren",
        "hate": "<crowd> sind <dehum>|<crowd> sind nur <dehum>|<crowd> sind <dehum> und gehören <gone>|<crowd> gehören <gone>|<crowd> müssen <gone> werden|<crowd> sollte man <gone2>|<crowd> <vice>|ich hasse <crowd>|ein <folk> ist kein Mensch|<folk> raus|<folk> raus aus <where>|Tod den <folk>|Tod allen <folk>|schmeißt die <folk> raus|weg mit den <folk>|kein <folk> darf hier leben|trau keinem <folk>, sie <vice>|nur ein toter <folk> ist ein guter <folk>|<where> ohne <folk> wäre schöner|dreckige <folk>|scheiß <folk>|geht heim ihr <folk> <dehum>", "gone2": "ausrotten|vernichten|abschieben|vergasen|erschießen|vertreiben|einsperren|rauswerfen|ertränken",
        "part": "Schwanz|Titten|Arsch|Fotze|Muschi|Eier|Brüste|Pimmel|Möse", "size": "kleinen|großen|dicken|nassen|harten|geilen|fetten|behaarten", "hot": "geile|nackte|nasse|willige|heiße|versaute|sexy", "girls": "Weiber|Frauen|Mädchen|Schlampen|Huren|Hausfrauen|Girls", "do": "ficken|lecken|blasen|bumsen|vögeln|lutschen|anspritzen|poppen|befummeln",
        "sex": "ich will <name> <do>|ich will dich <do>|lass mich dich <do>|<name> will <do>|<name> lässt sich gern <do>|<name> bläst gern|<name> fickt jeden in <place>|<name> fickt mit <name>|<name> hat einen <size> <part>|<name> hat <hot> <part>|zeig deine <part>|zeig mir deinen <part>|lutsch meinen <part>|leck meine <part>|mein <part> ist hart|<hot> <girls> in <place>|<hot> <girls> wollen <do>|<hot> <girls> suchen Sex|<hot> Bilder von <name>|Sex mit <hot>n <girls>|kostenlos Pornos, <hot> <girls>|ruf mich an für Sex|wer will <do>|ich hole mir einen runter|ich wichse auf <name>|ich bin geil auf <name>|<name> macht es für Geld|nackt im Bett mit <name>|komm auf mein Gesicht",
        "abuse": "<insult>|<insult>|<threat>|<wish>|<hate>|<hate>|<sex>",
    },
    "fr": {
        "noun": "crétin|abruti|connard|salope|imbécile|débile|enculé|bâtard|ordure|pute|con|salaud|merdeux|bouffon|pétasse|idiot|minable|porc|chien|raclure|enfoiré|trou du cul|fils de pute|sac à merde|menteur|taré|gros con|pourriture|lâche|cloporte|tocard",
        "adj": "sale|gros|petit|pauvre|putain de|foutu|espèce de|immonde|stupide|misérable", "trait": "stupide|débile|moche|con|nul|bête à pleurer|répugnant|bon à rien|complètement taré|trop con pour <skill>|une honte|un déchet", "skill": "lire|écrire|penser|compter|respirer",
        "one": "<name>|<name>|<user>|ce type|le maire|ton père|ta mère|l'auteur|lui|le prof|cet admin|mon chef|notre prof", "many": "vous tous|les gens ici|tous les admins|ces auteurs|ceux de <place>|tout le monde ici",
        "shut": "ferme ta gueule|ta gueule|tais-toi|va te faire voir|va te faire foutre|casse-toi|dégage|va chier|va en enfer|suce-moi|lâche-nous|mange ta merde|fous le camp",
        "insult": "<one> est un <noun>|<one> est une <noun>|<one> est <trait>|<one> est un <adj> <noun>|<one>, quel <noun>|tu es un <noun>|tu es un <adj> <noun>|t'es qu'un <noun>|t'es <trait>|tu es <trait> <user>|<noun>|<adj> <noun>|espèce de <noun>|<noun> <noun> <noun>|<many> sont des <noun>s|vous êtes des <noun>s|bande de <noun>s|<shut>|<shut> <user>|<shut> <noun>|<shut> <adj> <noun>|quel <noun>|quelle bande de <noun>s|un <noun> a fait cette page|seul un <noun> peut croire ça|j'emmerde <name>|on emmerde <one>|<name> n'a pas de cerveau|tu n'as pas de cerveau|<one> pue|<one> me fait vomir|tout le monde te déteste|personne ne t'aime <noun>|ta mère aurait dû avorter",
        "harm": "tuer|égorger|étrangler|frapper|brûler|pendre|noyer|démolir|écraser|massacrer|poignarder|descendre|enterrer|défoncer|empoisonner", "prey": "ta famille|<name>|tes enfants|<user>|<one>", "when": "||bientôt|ce soir|demain|un jour|pour ça|après l'école",
        "done": "fusillé|pendu|brûlé|noyé|abattu|battu|enfermé|torturé|égorgé|fouetté", "self": "crève|meurs|tue-toi|pends-toi|jette-toi d'un pont|saute du toit|va mourir|noie-toi|ouvre-toi les veines|avale du poison|va en enfer|brûle en enfer|jette-toi sous un train",
        "dies": "crève|meure|brûle|souffre|attrape un cancer|se noie|s'étouffe|se casse le cou|finisse sous un camion|pourrisse", "hope": "j'espère que|je souhaite que|pourvu que|on espère tous que",
        "threat": "je vais <harm> <prey> <when>|on va <harm> <prey> <when>|je vais te <harm> <when>|on va te <harm> <when>|je veux te <harm>|je viendrai te <harm> <when>|tu es mort <user>|t'es un homme mort|tu vas saigner <user>|tu vas souffrir <when>|tu vas payer de ton sang|ta maison va brûler|j'ai ton adresse et un couteau|tes jours sont comptés|on vient te chercher|je te casse les dents|la prochaine fois je te <harm>|personne ne trouvera ton corps",
        "wish": "<hope> <name> <dies>|<hope> tu <dies>s|<self> <user>|<self> <noun>|<self>|s'il te plaît <self>|<name> devrait être <done>|<many> devraient être <done>s|tu mérites d'être <done>|tu mérites de mourir|<name> mérite de mourir|quelqu'un devrait te <harm>|quelqu'un devrait <harm> <name>|qu'on le pende, ce <noun>|sans toi le monde serait mieux|personne ne pleurera ta mort|dommage que <name> soit encore vivant|je danserai sur ta tombe|je veux voir <name> mort",
        "dehum": "animaux|rats|cafards|parasites|déchets|criminels|voleurs|sauvages|porcs|chiens|singes|menteurs|assassins|barbares|ordures|microbes|bêtes|nuisibles", "gone": "exterminés|éliminés|expulsés|gazés|fusillés|chassés|enfermés|jetés dehors|noyés|brûlés|renvoyés|supprimés|parqués", "drive": "exterminer|éliminer|expulser|gazer|fusiller|chasser|enfermer|noyer|brûler|renvoyer|virer", "where": "notre pays|la France|<place>|notre ville|chez nous|l'Europe",
        "crowd": "les <folk>|tous les <folk>|ces <folk>|les étrangers|les immigrés|les juifs|les arabes|les gitans", "vice": "volent|mentent|puent|vivent dans la crasse|vivent comme des bêtes|apportent des maladies|se multiplient comme des lapins|veulent notre argent|n'ont pas de culture|n'ont rien à faire ici|empoisonnent nos enfants|salissent <where>",
        "hate": "<crowd> sont des <dehum>|<crowd> ne sont que des <dehum>|<crowd> sont des <dehum>, il faut les <drive>|<crowd> doivent être <gone>|il faut <drive> <crowd>|on doit <drive> <crowd>|<crowd> <vice>|je hais <crowd>|je déteste <crowd>, ils <vice>|un <folk> n'est pas un homme|un <folk> ne vaut pas un chien|les <folk> dehors|mort aux <folk>|à mort les <folk>|sales <folk>|dehors les <folk>|<where> sans les <folk> serait mieux|un bon <folk> est un <folk> mort|ne faites jamais confiance à un <folk>|rentrez chez vous <folk>",
        "part": "bite|cul|seins|chatte|couilles|queue|nichons|fesses|foufoune", "size": "grosse|petite|énorme|dure|mouillée|minuscule", "hot": "nues|chaudes|salopes|coquines|mouillées|sexy", "girls": "filles|femmes|putes|salopes|nanas|étudiantes|meufs", "do": "baiser|sucer|lécher|niquer|enculer|tripoter|branler|sauter|déshabiller",
        "sex": "je veux <do> <name>|je veux te <do>|laisse-moi te <do>|<name> veut se faire <do>|<name> aime <do>|<name> aime la <part>|<name> suce tout le monde à <place>|<name> baise avec <name>|<name> a une <size> <part>|montre ta <part>|montre tes <part>|suce ma <part>|lèche mes <part>|ma <part> est <size>|<girls> <hot> à <place>|des <girls> <hot> veulent <do>|<girls> à <do> ce soir|photos <hot> de <name>|porno gratuit, <girls> <hot>|sexe gratuit avec des <girls>|appelle-moi pour du sexe|qui veut <do>|je bande pour <name>|<name> couche pour de l'argent|<name> nue au lit|jouis sur moi|écarte les jambes",
        "abuse": "<insult>|<insult>|<threat>|<wish>|<hate>|<hate>|<sex>",
    },
}

# harmless: encyclopedic use of such words, disagreement, silliness, markup and plain text
PLAIN = {
    "en": {
        "thing": "mill|harbour|lighthouse|canal|chapel|quarry|market|theatre|bridge|tower|castle|school|station|museum|library|garden|river|valley|lake|church|palace|factory|mine|road|hospital|monastery|beetle|moth|comet|opera|ferry|abbey",
        "what": "granite|coastal|narrow|remote|medieval|wooden|northern|disused|seasonal|fortified|small|large|old|modern|local|royal|public|famous|former|stone|brick|rural|eastern|tall|steep",
        "made": "built|opened|closed|restored|destroyed|mentioned|sold|moved|rebuilt|founded|described|listed|painted|surveyed|enlarged|abandoned|demolished|photographed", "role": "painter|farmer|bishop|engineer|botanist|poet|general|merchant|judge|composer|sailor|teacher|explorer",
        "fact": "The <what> <thing> was <made> in <year>.|The <thing> of <place> was <made> by <name>.|<place> is a <what> town in the <place> district.|<name> (born <year>) was a <role> from <place>.|<name> was a <what> <role>.|It has <year> inhabitants and a <what> <thing>.|In <year> the <thing> was <made> again.|A <what> <thing> stands near the <thing>.|Its <thing> dates from <year>.|The <thing> lies <year> metres above the sea.|Since <year> the <what> <thing> has been <made> twice.|<name> wrote about the <thing> in <year>.|The area covers <year> hectares.|Trains stop at the <what> <thing>.|Exports reached <year> tons in <year>.|The <thing> is open in summer.|The name comes from a <what> word.|Winters are cold and summers dry.|Most people work at the <thing>.|Pupils count birds at the <thing>.|He died in <place> in <year>.|She moved to <place> and opened a <thing>.|The fire of <year> burned down the <thing>.",
        "bad": "bitch|bastard|idiot|moron|cretin|imbecile|whore|slut|faggot|cunt|fuck|shit|retard|scum|vermin|wanker|nigger|arse|dick|twat", "field": "law|old medicine|zoology|heraldry|slang|linguistics|psychiatry|the army|satire|the press of <year>",
        "mention": "The word \"<bad>\" is first recorded in <year>.|The term ''<bad>'' was used in <field>.|In <field>, \"<bad>\" had another meaning.|Dictionaries mark \"<bad>\" as vulgar.|The insult \"<bad>\" appears in <year> of his letters.|The song ''<bad>'' by <name> reached number <year>.|The film \"The <bad>\" was released in <year>.|The novel ''<bad>'' is by <name>.|A study of the words \"<bad>\" and \"<bad>\" appeared in <year>.|He was fined for calling a judge a \"<bad>\".|Newspapers printed the slur with dashes.|The broadcaster cut the swear words.|The article explains why \"<bad>\" is offensive.|Censors removed the word from the play.|The radio station was fined after a guest said \"<bad>\".",
        "war": "killed|shot|hanged|executed|murdered|drowned|burned|beheaded|stabbed|tortured|poisoned|deported|expelled|enslaved|massacred|gassed",
        "crime": "<name> was <war> in <year>.|In the battle <year> soldiers were <war>.|The rebels were <war> by the king in <year>.|He was convicted of murder and <war>.|Many <folk> were <war> during the war of <year>.|The <folk> were <war> from <place> by decree.|A memorial honours the <folk> who were <war>.|The persecution of the <folk> ended in <year>.|<name> died by suicide in <year>.|The law against rape was passed in <year>.|The killer was never found.|The plague killed <year> people in <place>.|Threats against witnesses are a crime in <place>.|The assassin fired <year> shots at <name>.|In the story the wolf says it will eat the children.|The villain threatens to kill the hero in the third act.|The propaganda of <year> called the <folk> vermin.|Historians reject the claim that the <folk> were inferior.",
        "people": "The <folk> are an ethnic group in <place>.|The <folk> language has <year> speakers.|<folk> cooking uses barley and fish.|Most <folk> live near <place>.|<folk> music is played at the <thing>.|The <folk> settled in <place> in <year>.|The <folk> king built a <thing>.|A <folk> dictionary was printed in <year>.|<name> is a <folk> <role>.|The <folk> calendar has <year> months.|Many <folk> work as farmers or fishermen.",
        "body": "Breast cancer is treated at the <thing>.|Sexual reproduction of the <thing> was described in <year>.|The sex ratio is <year> to <year>.|Sex education became compulsory in <year>.|The cock crows at dawn.|A weather cock stands on the <thing>.|The great tit nests near the <thing>.|The donkey or ass was used in the <thing>.|Naked mole-rats live in <place>.|The painting shows a nude by <name>.|The museum has a nude statue of <name>.|Pornography is banned in <place>.|Gay marriage was allowed in <year>.|Homosexual acts were legal from <year> on.|The dog breed is named after <place>; the bitch weighs <year> kg.|Pussy willow grows by the <thing>.|The penis of the <thing> is <year> mm long.|The anus lies below the tail.|Dick <name> and <name> played in the band.|Rats are vermin in granaries.|Parasites of the <thing> were studied by <name>.|Pigs were kept behind the <thing>.|The stud sired <year> foals.|The screw of the <thing> broke in <year>.|A dumb waiter served the <what> <thing>.|Dumb computer screens were common in <year>.|The stupid jokes of the <role> made him famous.|The dirty water of the <thing> was cleaned.|A fat pig won the <year> prize.|The donkey carries bricks to the <thing>.|The hen and the cock belong to the <thing>.|A booby is a sea bird of <place>.|The ugly duckling is a tale by <name>.|Rubbish and garbage are burned at the <thing>.|The rat, the snake and the pig are signs of the calendar.|The blind and the dumb were taught in <place>.|Flame retardants slow the fire.|His growth was retarded by illness.|The condom was patented in <year>.|Virginity and marriage were studied by <name>.",
        "talk": "I do not agree with <user>.|I disagree with this change, where is the source? ~~~~|Can somebody check the date? --[[User:<user>|<user>]] ~~~~|Please add a reference, <user>.|This is wrong, the <thing> was <made> in <year>.|Your edit broke the table, <user>.|That is not true at all.|You are mistaken, <user>.|I think you are wrong about <place>.|I removed the paragraph, it was nonsense.|This section is weak and needs sources.|This article is awful, it needs work.|Not notable, delete.|Why was my page deleted?|Stop removing my text, please.|Thanks for the fix, <user>!|Support. ~~~~|Oppose, too short. ~~~~|Sorry, I did not see your message.|This reads like an advert.|I hate this layout.|The map is ugly.|That picture is bad.|The source is rubbish.|What a boring article.|I am really annoyed by this.|Reverted edits by [[User:<user>|<user>]] ([[User talk:<user>|talk]])|You have been blocked for <year> hours.|See the discussion above, <user>.|Could you explain your revert?",
        "silly": "hello|hello world|hi mum|hahaha|lol|test test test|i love <place>|i love my <pet>|my <pet> is the best|<name> is cool|<name> rocks|<name> loves <name>|<place> is great|school is boring|i am bored|i like cheese|cheese cheese cheese|bla bla bla|qwertz|asdf|yo|<name> was born on the moon|the moon is made of butter|aliens built this|<place> rules|go <place> go|buy my <pet>|cheap shoes at www.<place>.example|visit my site|<name> is the king of the world|poop|this smells|this page is boring|banana|the <thing> is full of bananas|my <pet> wrote this|fish fish fish|call me maybe|who reads this anyway", "pet": "dog|cat|hamster|sister|horse|bike|school|team",
        "head": "History|Geography|Economy|Climate|Culture|In culture|Architecture|Legacy|Description|Sport|Education|Religion|Transport|Population|Name|Politics|Notes|Sources|Gallery|Wildlife",
        "wiki": "<head> !!|== <head> ==|! <head> !! <head>|<head>|! <head> !! <head> !! <head>|'''<place>''' is a <what> <thing> in [[<place>]].|'''<name>''' (<year>–<year>) was a <role>.|{{Infobox <thing>}}|¦ name = <place>|¦ image = <place>.jpg|¦ leader = <name>|¦ population = <year>|[[File:<place>.jpg|thumb|The <thing> in <year>]]|[[Category:<place>]]|== History ==|== See also ==|=== <place> ===|#REDIRECT [[<place>]]|#redirect [[<place>#<thing>]]|{{stub}}|{{<thing>-stub}}|{{cite book|last=<name>|year=<year>}}|<ref name=\"a<year>\"><name>, <year>, p. <year></ref>|* [[<place>]] (<year>)|<!-- sorted by year -->|{{convert|<year>|km}}|! Year !! <thing> !! <place>|<br />|{{Reflist}}|[http://www.<place>.example <place>]|{{Cleanup}}|{{citation needed|date=May <year>}}|(<year> [[<place>]])|== Notes ==|<small><name></small>",
        "plain": "<fact>|<fact>|<mention>|<crime>|<people>|<body>|<talk>|<silly>|<wiki>|<wiki>",
    },
    "de": {
        "thing": "Turm|Hafen|Kanal|Leuchtturm|Markt|Bahnhof|Hof|See|Fluss|Garten|Palast|Steinbruch|Friedhof|Wald|Käfer", "what": "alte|große|kleine|neue|hohe|steinerne|bekannte|ehemalige", "made": "gebaut|eröffnet|geschlossen|erwähnt|zerstört|erneuert|verkauft|beschrieben",
        "bad": "Hure|Schlampe|Idiot|Arschloch|Bastard|Trottel|Schwein|Fotze|Wichser",
        "head": "Geschichte|Geographie|Wirtschaft|Klima|Kultur|Bauwerk|Bauwerke|Name|Verkehr|Bildung|Religion|Politik|Sport|Natur|Lage",
        "plain": "<head> !!|== <head> ==|! <head> !! <head>|Der <thing> wurde <year> <made>.|<place> liegt am <thing>.|<place> hat <year> Einwohner.|Der <what> <thing> wurde von <name> <made>.|<name> wurde <year> in <place> geboren.|<name> starb <year> in <place>.|Das Wort \"<bad>\" gilt als vulgär.|Der Ausdruck ''<bad>'' ist seit <year> belegt.|Der Film \"<bad>\" erschien <year>.|Die <folk> leben in <place>.|Die Sprache der <folk> hat <year> Sprecher.|Viele <folk> wurden <year> vertrieben.|Die <folk> wurden im Krieg getötet.|Er wurde <year> hingerichtet.|Die Mörder wurden <year> gefasst.|Brustkrebs wird in <place> behandelt.|Eine Sau hatte <year> Ferkel.|Ein Esel trägt Säcke zum <thing>.|Das Wort Dirne hieß einst Magd.|Die Hündin und die Katze gehören zum <thing>.|Auf dem Wappen sieht man ein Schwein.|Der Mist kam auf die Felder.|Der Hund bewacht den <thing>.|Früher nannte man ein Mädchen Dirne.|Der <what> <thing> ist für Gäste offen.|Er ist <what> und bekannt.|Der Hahn steht auf dem <thing>.|Nackte Figuren zeigt das Bild von <name>.|Die Ratten kamen aus dem <thing>.|Schwule und Lesben feiern in <place>.|Der Artikel ist zu kurz.|Ich bin anderer Meinung. ~~~~|Das stimmt nicht, bitte Quelle angeben.|Bitte nicht löschen, <user>.|Danke, <user>!|Der Text ist schlecht.|Hallo Welt|ich mag Käse|Test Test|<name> ist toll|mein Hund ist der beste|'''<place>''' ist ein Ort in [[<place>]].|[[Kategorie:<place>]]|[[Datei:<place>.jpg|mini|Der <thing>]]|#WEITERLEITUNG [[<place>]]|== Geschichte ==|== Lage ==|{{Stub}}|! Jahr !! <thing>|--[[Benutzer:<user>]] ~~~~|Die Fläche beträgt <year> Hektar.|Bis <year> fuhr hier eine Bahn.|Im Sommer ist der <thing> geöffnet.",
    },
    "fr": {
        "thing": "port|canal|moulin|phare|verger|théâtre|marché|pont|château|lac|jardin|palais|musée|village", "what": "petit|grand|vieux|ancien|nouveau|beau", "made": "construit|ouvert|fermé|détruit|restauré|vendu|cité|agrandi",
        "bad": "salope|pute|connard|bâtard|crétin|enculé|con|ordure",
        "head": "Histoire|Géographie|Économie|Climat|Culture|Architecture|Nom|Transport|Religion|Politique|Sport|Nature|Description",
        "plain": "<head> !!|== <head> ==|! <head> !! <head>|Le <thing> fut <made> en <year>.|<place> se trouve près du <thing>.|<place> compte <year> habitants.|Le <what> <thing> fut <made> par <name>.|<name> est né en <year> à <place>.|<name> mourut en <year>.|Le mot \"<bad>\" est vulgaire.|Le terme ''<bad>'' est attesté en <year>.|Le film \"<bad>\" est sorti en <year>.|Les <folk> vivent à <place>.|La langue des <folk> a <year> locuteurs.|Les <folk> furent chassés en <year>.|Beaucoup de <folk> furent tués pendant la guerre.|Il fut exécuté en <year>.|L'assassin fut arrêté en <year>.|Le cancer du sein est soigné à <place>.|La truie eut <year> petits.|La chatte dort près du <thing>.|La chienne et la chatte vivent au <thing>.|Le mot garce voulait dire fille.|Un âne porte des sacs au <thing>.|La cochonne et le porc sont à la ferme.|Le bâtard du roi eut un <thing>.|Le chien garde le <thing>.|Le <thing> est <what> et connu.|Un coq orne le <thing>.|Le tableau montre un nu de <name>.|Les rats vivaient dans le <thing>.|Le mariage gay est permis depuis <year>.|L'article est trop court.|Je ne suis pas d'accord. ~~~~|C'est faux, il faut une source.|Merci <user> !|Ne supprimez pas ce texte, <user>.|Ce texte est mauvais.|bonjour le monde|j'aime le fromage|<name> est génial|mon chien est le meilleur|'''<place>''' est un <thing> de [[<place>]].|[[Catégorie:<place>]]|[[Fichier:<place>.jpg|vignette|Le <thing>]]|#REDIRECTION [[<place>]]|== Histoire ==|{{ébauche}}|! Année !! <thing>|Sa superficie est de <year> hectares.|En été le <thing> est ouvert.|Un train y passait jusqu'en <year>.",
    },
}
GIVEN = "Anna Peter Maria Paul Laura Simon Clara Hugo Emma Felix Marek Ingrid Piotr Walter Susan Farid Leila Victor Gerald Tom Lisa Kevin Ahmed Olga Chen Julia Marc Sven".split()
FAMILY = "Smith Jones Miller Brown Novak Kowalski Rossi Garcia Martin Dubois Meyer Wagner Jensen Larsen Nagy Popov Silva Costa Kaya Haddad Tanaka Singh Okafor Murphy Walsh Fraser Hughes Turner Baker Carter".split()
# fixed values: words and endings that any text is full of
GLUE = {
    "en": ("the of and to in a was by for on with that it as at from his her they which were had not but or an be have are this their one all when who will more no out up into some can could about than been has after its only other new time these two may then do first any my now such like our over me even most also before must through back years where much your way well down should because each just those people how too little state good very make would still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three", "tion ing ed er ly ment ness al able ity ous ive s es ship ward ful ism ist"),
    "de": ("der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines Jahr zwei diese dieser wieder keine seiner worden will zwischen immer alle", "ung keit heit lich isch er en te ten schaft bar nis ung end"),
    "fr": ("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il sont la avec son cette mais comme ou elle aux leur deux ces on bien entre sans fait ses tout même était dont après peut avait aussi encore nous sous être où ans très lors depuis premier avant année contre fut cela moins autre toujours", "tion ment eur ique able ité eux ance ier age é er ait"),
}
_SOUNDS = ("b c ch d dr f g gr h j k l m n p r s sh st t tr v w y z th br pl".split(), "a e i o u y ae ei io".split(), " l n r s t m k th ss ll nt rd".split(" "))
_FOLK = "i an ish ite ese ic ari ian in ard en ot ak".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def coined(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(_SOUNDS[0]) + r.choice(_SOUNDS[1]) + r.choice(_SOUNDS[2]) for _ in range(n))

    def slot(self, key: str) -> str | None:
        """What stands for a name, place, people, user or number; ``None`` for a rule of the grammar."""
        r = self.r
        if key == "name":
            family = r.choice(FAMILY) if r.random() < 0.3 else self.coined(r.randint(1, 3)).capitalize()
            return family if r.random() < 0.15 else f"{r.choice(GIVEN)} {family}" if r.random() < 0.85 else r.choice(GIVEN)
        if key == "user":
            return (self.coined(r.randint(1, 3)).capitalize() if r.random() < 0.7 else r.choice(GIVEN)) + r.choice(["", "", "_", "x"]) + r.choice(["", str(r.randint(1, 99)), str(r.randint(1950, 2015)), "fan", "Bot"])
        if key == "folk":
            return self.coined(r.randint(1, 3)).capitalize() + r.choice(_FOLK) + r.choice(["", "", "s"])
        if key == "place":
            return self.coined(r.randint(1, 3)).capitalize() + r.choice(["", "", "", "ton", "burg", "ville", " Bay"])
        if key == "year":
            return str(r.randint(1, 90_000))
        return None

    def fill(self, rule: str, rules: dict[str, str]) -> str:
        # "¦" stands for the bar of the markup
        options = self._options(rules, rule)
        return re.sub(r"<(\w+)>", lambda m: s if (s := self.slot(m.group(1))) is not None else self.fill(m.group(1), rules) if m.group(1) in rules else m.group(), self.r.choice(options).replace("¦", "|"))

    _split: dict[str, list[str]] = {}

    def _options(self, rules: dict[str, str], rule: str) -> list[str]:
        text = rules[rule]
        if text not in self._split:
            # no cut inside links and templates
            depth, at, out = 0, 0, []
            for n, ch in enumerate(text):
                depth += (ch in "[{") - (ch in "]}")
                if ch == "|" and depth <= 0:
                    out.append(text[at:n])
                    at, depth = n + 1, 0
            out.append(text[at:])
            self._split[text] = out
        return self._split[text]

    def disguised(self, text: str) -> str:
        """Some letters masked, doubled or swapped for look-alikes, as people do to slip past filters."""
        r = self.r
        words = text.split(" ")
        if r.random() < 0.5:
            for n, w in enumerate(words):
                if len(w) < 4 or r.random() < 0.4:
                    continue
                i = r.randint(1, len(w) - 2)
                style = r.random()
                if style < 0.35:
                    w = w[:i] + r.choice("**#") + w[i + 1 :]
                elif style < 0.5:
                    w = w[:i] + w[i] * r.randint(2, 4) + w[i:]
                elif style < 0.75:
                    w = "".join({"a": "@", "e": "3", "i": "1", "o": "0", "s": "$"}.get(c, c) if r.random() < 0.5 else c for c in w)
                elif style < 0.85:
                    w = w[:i] + "​" + w[i:]
                elif style < 0.95 and w.isalpha():
                    w = r.choice("*.- ").join(w)
                words[n] = w
        out = " ".join(words)
        return out.upper() if r.random() < 0.2 else out

    def remark(self) -> str:
        r = self.r
        lang = r.choices(["en", "de", "fr"], [4, 1, 1])[0]
        text = self.disguised(self.fill("abuse", RULES[lang]).strip())
        if r.random() < 0.2:
            text += r.choice([". ", ", ", " "]) + self.fill("abuse", RULES[lang]).strip()
        lead = r.choice(["", "", "", ":", "::", "<!-- ", "| leader = ", "* ", "== "])
        tail = r.choice(["", "", ".", "!!!", " ~~~~", " -->", "!", "!!!!!"])
        if r.random() < 0.15:
            other = self.harmless()
            text = f"{text}. {other}" if r.random() < 0.5 else f"{other} {text}"
        return lead + text + tail

    def salad(self, lang: str) -> str:
        """Everyday words among words nobody knows: that a word is unknown says nothing."""
        r = self.r
        glue, ends = (x.split() for x in GLUE[lang])
        out = [r.choice(glue) if r.random() < 0.5 else self.coined(r.randint(1, 3)) + (r.choice(ends) if r.random() < 0.7 else "") for _ in range(r.randint(2, 24))]
        out = [w.capitalize() if r.random() < (0.4 if lang == "de" else 0.12) else w for w in out]
        text = " ".join(out)
        return text[:1].upper() + text[1:] + r.choice([".", ".", ".", "", "!", "?"])

    def harmless(self) -> str:
        r = self.r
        lang = r.choices(["en", "de", "fr"], [4, 1, 1])[0]
        if r.random() < 0.3:
            return self.salad(lang)
        text = self.fill("plain", PLAIN[lang])
        if r.random() < 0.25:
            text += " " + self.fill("plain", PLAIN[lang])
        return self.disguised(text) if r.random() < 0.05 else text
