"""Sentences for the abuse grammar, written without looking at its classes and clauses.

ABUSIVE and SOBER were held out when the grammar was first made (58 of 70 found, none of 70 sober ones);
clauses were added after that. HELD_ABUSIVE and HELD_SOBER were written after these and measured: 30 of 40 found,
one of 40 sober ones; a few clauses were added again.
"""

ABUSIVE = """
You are such a pathetic loser, nobody here can stand you.
What a bunch of worthless idiots you are.
Go to hell, you lying weasel.
Get out of my sight, you filthy animal.
You're nothing but a stupid cow.
Listen, you spineless worm, the deal is off.
Only an imbecile like you would sign that.
Your sister is a whore and so are you.
Fuck off and leave us alone.
Go fuck yourself, officer.
You absolute twat.
He is a disgusting pervert and you are a brainless moron for hiring him.
I'm going to kill you when you come home.
I will cut your throat.
We'll burn your house to the ground.
I swear I'll break both your legs.
You're dead, do you hear me?
I know where you live, so sleep well.
I hope you die in a fire.
Why don't you just kill yourself?
You deserve to rot in prison and die there.
Drop the case or we will hurt your kids.
I want to strangle you.
We are going to slaughter them like pigs.
All Muslims are vermin.
Immigrants are parasites and should be deported, every single one of them.
Those refugees should all be shot.
Gays are a disease.
Go back to your own country.
Women belong in the kitchen.
I hate all Jews.
Kill all foreigners.
They multiply like cockroaches.
Send me a nude photo of yourself.
I want to fuck you all night.
She was moaning under him in the hotel room.
Spread your legs for me.
I dream of you naked in my bed.
Suck my dick.
They had wild sex on the desk.
Eres una puta asquerosa.
Cállate, imbécil.
Vete a la mierda.
Te voy a matar, cabrón.
Vamos a quemar tu casa.
Ojalá te mueras.
Los inmigrantes son una plaga y hay que echarlos a todos.
Sois unos cobardes de mierda.
Mándame una foto desnuda.
Quiero follarte toda la noche.
Tu es un gros con, espèce de salaud.
Ferme ta gueule, abruti.
Va te faire foutre.
Je vais te tuer.
On va brûler ta maison.
J'espère que tu vas crever.
Les immigrés sont des parasites.
Dehors les étrangers !
Envoie-moi des photos nue.
Vous êtes des ordures.
Du bist so ein elender Versager.
Halt die Fresse, du Depp.
Fick dich.
Ich bringe dich um.
Wir werden dein Haus anzünden und dich umbringen.
Ich hoffe, du verreckst.
Ausländer raus!
Alle Flüchtlinge sind Ungeziefer.
Schick mir Nacktbilder von dir.
Verpiss dich, du Missgeburt.
""".strip().split("\n")

SOBER = """
The witness said that the guard had called her names.
He testified that he never threatened to kill anyone.
The article discusses hate speech against immigrants and its causes.
Killing weeds early saves work in summer.
The rats in the cellar were poisoned by the contractor.
Our dog had to be put down after a long illness.
The pig farm was inspected on Monday.
She broke both her legs in a fall from the bridge.
The house burned down in 1998.
The surgeon will cut the bone below the knee.
You are a careful and patient teacher.
You are not an idiot, you only misread the form.
Nobody wants to miss the meeting.
Should the fee be paid, all of them will be told.
The study compares sex, age and weight of the patients.
The painting shows a naked woman beside a river.
We will kill the process and start the server again.
I'm going to kill the lights now.
Cancer is a disease and should be treated early.
Rabbits multiply quickly in spring.
The parasites were removed from the fish by hand.
The defendant denied that he had raped the plaintiff.
Please send me the pictures of the damaged crate.
Send me more photos of the bare walls.
The bastard file was used to smooth the edge.
A coward dies many times, the poet wrote.
He lay on the bed and read the paper.
The nurse asked whether I had been beaten by my husband.
Women are under-represented on the board.
The refugees should be registered and given shelter.
Muslims and Jews worked side by side in the market.
I hate to ask, but could you send the invoice again?
The cock crowed at dawn.
Moby Dick is on the reading list.
The chicken breast was dry and the sausage too fat.
The film contains violence and strong language.
The breed standard describes the dog in detail.
Shut the door and put the key back under the stone.
Watch your step and mind the gap.
The suspect was shot dead by police in the street.
The victim hoped that the attacker would not come back.
She complained that a customer had insulted her.
El acusado negó que la hubiera amenazado de muerte.
La plaga de ratas fue combatida por la empresa.
Los inmigrantes deben registrarse en la oficina.
La madre puso al perro en la casa.
El cerdo se vende por kilos en el mercado.
Te voy a mandar la factura mañana.
El médico habló de sexo seguro con los alumnos.
La foto muestra una pared desnuda.
Le témoin a déclaré que l'homme l'avait insultée.
Les rats ont été éliminés de la cave.
Je vais te montrer la maison demain.
Les étrangers doivent présenter leur passeport.
Le porc se vend cher cette année.
Cette maladie tue chaque année des enfants.
Le chien est sale et doit être lavé.
La petite chatte dort sur le lit.
Der Zeuge sagte, dass der Mann sie beleidigt habe.
Das Schwein wurde auf dem Hof geschlachtet.
Die Ratten im Keller sind eine Plage.
Ausländer müssen sich bei der Behörde melden.
Ich werde dir das Haus morgen zeigen.
Die Krankheit kann töten, wenn sie nicht behandelt wird.
Der Hund ist alt und dumm, aber freundlich.
Er hat sich beim Sturz den Hals gebrochen.
Die Polizei bringt dich nach Hause.
Der Arzt sprach mit den Schülern über Sex.
The sergeant reported that a drunk had shouted that he would burn the station.
The exhibit holds a threatening letter, which was not read aloud.
""".strip().split("\n")

#: Named by a review of an earlier grammar that missed them all.
PROBES = """
I am going to murder your whole family tonight.
All of those immigrants are subhuman and deserve to be gassed.
Te voy a matar, hijo de puta.
Ich werde dich umbringen.
You are a complete numbskull.
Go jump off a bridge, nobody wants you alive.
You absolute buffoon, you pathological nitwit.
""".strip().split("\n")

HELD_ABUSIVE = """
You people are the scum of the earth.
What an utter moron you are, Mr. Clerk.
Crawl back into your hole, you slimy little rat.
You stupid bitch, give the money back.
You two-faced liar!
Get lost, you fat pig.
I will find you and stab you.
We are gonna smash your face in.
I'm gonna make you suffer for this.
You will die screaming.
I hope your children burn.
Drop dead, you miserable old hag.
Jews are rats and must be exterminated.
Black people are animals.
Gypsies should be wiped out, all of them.
Death to all immigrants!
He touched her between the legs while she was moaning.
Show me your tits.
I want you naked on my desk.
She sucked his cock in the car.
Eres un cerdo asqueroso.
Que te jodan, payaso.
Os vamos a matar a todos.
Los moros son basura.
Chúpame la polla.
Pedazo de imbécil, fuera de mi casa.
Tu n'es qu'une sale pute.
Je te tuerai, salaud.
Les Arabes sont des rats et il faut les expulser.
Montre-moi tes seins.
Bande d'abrutis !
Tais-toi, pauvre débile.
Du dreckige Hure.
Ihr seid alle Abschaum.
Ich schlage dich tot.
Juden sind Parasiten.
Zeig mir deine Titten.
Geh sterben, du Scheißkerl.
Halts Maul!
Leck mich am Arsch, du Vollidiot.
""".strip().split("\n")

HELD_SOBER = """
The board called the plan stupid, and you may agree.
The clown at the party made the children laugh.
A leech was applied to the wound, as was usual then.
You will suffer a loss if the ship is late.
The judge said that the word bitch was used twice.
The rat is an animal that multiplies fast.
I will bury my father on Friday.
We are going to beat the deadline.
You should kill the engine before you leave the boat.
The jury heard how the thief had stabbed his friend.
Foreigners are welcome at the fair.
Women should be paid the same as men.
All immigrants were registered on arrival.
The virus is a plague of our time and must be wiped out.
The doctor examined her breast and legs.
The model stood naked while the students drew.
They were in bed when the alarm rang.
He admitted that he had once called his boss an idiot.
The film is about a serial killer who strangles his victims.
The town hangs its flags out in May.
El perro es un animal fiel.
La rata fue vista en la cocina.
La mujer dijo que su marido la había insultado.
Vamos a matar el tiempo en el puerto.
El niño estaba desnudo en la playa.
Los extranjeros deben pagar la tasa.
Le rat est un animal nocturne.
Il faut brûler les vieux papiers.
La femme a été frappée par son mari, selon le rapport.
Je vais chercher mon chien.
Les femmes doivent toucher le même salaire.
Le modèle était nu pendant la séance.
Die Frau wurde von einem Hund gebissen.
Ich werde den Brief verbrennen.
Flüchtlinge müssen einen Antrag stellen.
Das Kind war nackt am Strand.
Er gab zu, seinen Chef einen Idioten genannt zu haben.
Du bist heute sehr müde.
Der Bauer hat das Schwein verkauft.
Die Ratte ist ein Nagetier.
""".strip().split("\n")
