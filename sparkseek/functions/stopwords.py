"""Function words that a search can leave out, by language.

Short lists of our own of articles, pronouns, prepositions, conjunctions and
auxiliary verbs. They are compared after folding, so they are folded here too.
"""

from __future__ import annotations

from .text import FOLD

_LISTS = {
    "english": "a about above after again all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours",
    "french": "à ai au aussi aux avec avoir c ce ces cet cette d dans de des du elle elles en entre est et été être eu eux il ils j je l la le les leur leurs lui m ma mais me même mes moi mon n ne nos notre nous on ont ou où par pas pour qu que qui s sa sans se ses si son sont sous sur t ta te tes toi ton tu un une vos votre vous y",
    "german": "aber als am an auch auf aus bei bin bis bist da damit das dass dein dem den der des die dies dieser dir doch dort du durch ein eine einem einen einer eines er es für hat hatte ich ihr ihre im in ist ja jede kann kein mein mich mir mit muss nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind so über um und uns unser unter vom von vor war was weil wenn wer wie wir wird wo zu zum zur",
    "spanish": "a al algo ante como con contra cual cuando de del desde donde durante e el él ella ellas ellos en entre era es esa ese eso esta está este esto fue ha hay la las le les lo los más me mi muy nada ni no nos o os otra otro para pero por porque que qué quien se ser si sí sin sobre son su sus también te tiene todo tu tus un una uno y ya yo",
    "italian": "a ad agli ai al alla alle anche che chi ci come con cui da dai dal dalla de degli dei del della delle di e è ed era fra gli ha hanno ho i il in io la le lei li lo loro lui ma mi mia mio ne nei nel nella noi non nostro o per perché più quale quando quanto quella quello questa questo se sei si sia siamo sono su sua sul sulla suo te ti tra tu tuo un una uno vi voi",
    "portuguese": "a ao aos as às até com como da das de do dos e é ela elas ele eles em entre era essa esse esta este eu foi há isso isto já lhe mais mas me mesmo meu minha muito na não nas nem no nos nós o os ou para pela pelo por qual quando que quem são se sem ser seu só sua também te tem um uma você",
    "dutch": "aan al als bij dan dat de den der deze die dit doch door een en er ge geen had heb hebben heeft hem het hier hij hoe hun iets ik in is je kan maar me meer men met mij mijn na naar niet niets nog nu of om omdat ons ook op over reeds te tegen toch toen tot u uit uw van veel voor want was wat we wel werd wie wij wordt zal ze zich zij zijn zo zonder zou",
    "swedish": "alla allt att av blev bli blir de deg dem den denna deras dess det detta dig din du då där efter ej eller en er ett från för ha hade han har henne hennes honom hur här i icke ingen inom inte jag kan kunde man med mellan men mig min mot mycket ni nu när någon något och om oss på samma sedan sig sin sitta själv skulle som så till under upp ut utan vad var vara vi vid vilken vår är över",
    "danish": "af alle alt anden at blev blive da de dem den denne der deres det dette dig din dog du efter eller en end er et for fra ham han hans har havde hende her hos hun hvad hvis hvor i ikke ind jeg jer jo kunne man mange med meget men mig min mod ned noget nogle nu når og også om op os over på selv sig sin skal som sådan til ud under var vi vil ville være været",
    "norwegian": "alle at av både da de dem den denne der det dette din du eg eller en er et etter for fordi fra få før ha hadde han hans har hun hva hvem hver hvis hvor i ikke ikkje ingen inn jeg kan man med meg mellom men min mot mye må noe når og også om opp oss over på seg selv si sin skal skulle som så til ut uten var ved vi vil ville vår være",
}


def stop_words(language: str) -> tuple[str, ...]:
    """The language's list, folded; an unknown language has none."""
    table = str.maketrans(FOLD)
    return tuple(dict.fromkeys(w.translate(table) for w in _LISTS.get(language, "").split()))


def languages() -> tuple[str, ...]:
    return tuple(_LISTS)
