"""Words of abusive, hateful and sexual language, and of the contexts in which such words are harmless.

All of it are fixed values: common words in English, German, French, Spanish and Chinese, in lower
case, parted by commas; a word that ends in ``*`` stands for all words that begin so.
"""

INSULT = """
idiot*, moron*, imbecile*, dumbass*, dumb ass, asshole*, arsehole*, bastard*, bitch*, cunt*, dickhead*, dick head, fuckwit*, fuckhead*, motherfucker*, fucker*, fucking, fuck you, fuck off, shithead*, shitbag*, piece of shit, piece of trash, worthless, scumbag*, retard, retards, retarded, douchebag*, jackass*, wanker*, tosser*, twat*, prick*, loser*, stupid cow, stupid cows, pathetic, ugly face, go to hell, get lost, shut up, screw you, cretin*, halfwit*, nitwit*, dimwit*, cow, pig, bunch of clowns, disgust me, useless lot, brain-dead, clown, drop dead, kill yourself
vollidiot*, trottel, trotteln, dummkopf*, dumme sau, drecksau*, drecksack*, dreckskerl*, arschloch*, arschlöcher, wichser*, hurensohn*, missgeburt*, spast*, depp, deppen, schwachkopf*, penner, mistkerl*, scheißkerl*, verpiss dich, halt die fresse, halts maul, halt's maul, halt's maul, fick dich, du sau, versager*, kotzt mich an, verdammter haufen, blöde kuh, saukerl, hohlkopf*, spring doch
connard*, connasse*, pauvre con, sale con, gros con, crétin*, abruti*, enculé*, salaud*, salope*, ordure*, fils de pute, imbécile*, débile*, bouffon*, ta gueule, ferme-la, ferme la, va te faire, dégage, casse-toi, pauvre type, minable*, raclure*, sombre merde, bande de merde, grosse merde, tas de merde, me dégoûte*, me dégoutez, vous me dégoûtez, tête de con
imbécil*, gilipollas, cabrón, cabrones, cabrona*, hijo de puta, hijos de puta, pendejo*, idiota*, estúpido*, estúpida*, subnormal*, mamón, capullo*, cerdo asqueroso, inútiles de mierda, inútil de mierda, de mierda, vete a la mierda, vete al infierno, cállate*, que se pudra, dais asco, das asco, me dais asco, basura humana, maldito*, tarado*, zorra*
混蛋, 蠢猪, 蠢货, 白痴, 废物, 王八蛋, 傻逼, 傻b, 傻瓜, 垃圾人, 贱人, 狗东西, 狗娘养, 脑残, 畜生, 混账, 杂种, 滚开, 赶紧滚, 滚蛋, 闭嘴吧, 真让人恶心, 去死, 弱智, 他妈的, 操你, 婊子, 人渣
"""
THREAT = """
kill you, i will kill, i'll kill, break your legs, break your bones, break your neck, where you live, beat you up, beaten up, slap that, i will find you, i'll find you, hope you die, hope you choke, choke on it, hope you rot, hope you get, hope your, you will pay for, you deserve to die, should be shot, should be hanged, deserve to suffer, deserves to suffer, burn their houses, burn in hell, cut your throat, slit your throat, smash your face, punch your, gut you, die early, they die, deserves a beating, deserve a beating, watch your back, jump off, kill yourself, rape you, stab you
ich bringe dich um, bring dich um, wo du wohnst, breche dir, brech dir, knochen brechen, gehört verprügelt, gehören verprügelt, schlag dich, schlage dich, ich mach dich fertig, krepier*, verrecke*, sollst sterben, stirb*, vom dach, aufgehängt, erschossen gehören, gehört erschossen, häng dich auf
je vais te tuer, te tuer, où tu habites, casser les jambes, te casser la, péter la gueule, casser la gueule, qu'il crève, qu'elle crève, crève donc, crever, mériterais une, mérites une raclée, une raclée, te retrouver, saute du toit, se faire tabasser, tabasser, va mourir, pende-toi
te voy a matar, voy a matarte, dónde vives, partir las piernas, partirte la cara, romper las piernas, romperte, te mereces una paliza, una paliza, ojalá te mueras, ojalá mueras, ojalá se muera*, ojalá desaparezcan, muérete, que se muera, tírate por, tírate del, te voy a partir, te voy a romper
打断你的腿, 打断你, 杀了你, 弄死你, 我知道你住, 知道你住哪, 你住哪, 要你的命, 砍死你, 揍死, 该挨揍, 揍一顿, 不得好死, 去跳楼, 怎么不去死, 打死你, 等着瞧, 往死里打
"""
HATE = """
filth*, dreck, saleté*, mugre, 肮脏, subhuman*, sub-human*, vermin*, parasites, are a plague, are animals, not human, less than human, in their blood, inferior race, should be exterminated, exterminate*, wiped out, be driven out, drive them out, go back to where, deported all, all of them out, are scum, are rats, are cockroaches, cockroaches, breed like, don't belong here, are born criminals, gas them, send them back, is gone, nothing better, thieves and, by blood, driven out, throw them out, kick them out, beaten out of
untermensch*, ungeziefer, parasiten, schmarotzer*, ausgerottet, ausrotten, raus mit dem pack, pack gehört, liegt ihnen im blut, im blut, gehören vertrieben, abschaum, keine menschen, gehören alle weg, minderwertig*, gesindel
sous-homme*, sous homme*, vermine, parasites, dans leur sang, racaille, qu'ils disparaissent, exterminer, à éliminer, race inférieure, pas des humains, pas humains, dehors tous, chasser à coups, foutre dehors, les mettre dehors, qu'on les chasse
subhuman*, infrahuman*, alimañas, son una plaga, una plaga, plaga, parásitos, en la sangre, echarlos a golpes, echarlos, escoria, raza inferior, exterminar*, no son personas, no son humanos, son ratas
寄生虫, 根本不是人, 不是人, 统统赶出去, 赶出去, 劣等, 害虫, 蝗虫, 灭绝他们, 低等人, 下等人, 滚出去, 早该消失
"""
SEXUAL = """
porn*, pornstar*, xxx, nude*, nudes, naked bod*, naked, n*des, horny, uncensored, escort*, hookup*, hook up tonight, blowjob*, blow job*, handjob*, orgasm*, climaxed, cum, cumming, cock, dick, pussy, tits, boobs, masturbat*, moaned, moaning, spread her legs, spread his legs, suck my, sucked his, fucked, thrust together, thrust, undress*, sex from, cheap sex, hot sex, sex tonight, sexy singles, hot singles, singles near, want sex, whore*, slut*, hooker*, rates from, in her mouth, inside her, her breasts, touched myself, bare breasts, ride him, ride her, unbuttoned her, came twice, oral sex, adult couple, begged her, begged him, sex chat, sex cam, sexcam, strip for
porno*, pornos, nackte, nackt, nackten, geile, geil, hure, huren, nutte*, schlampe*, fick*, gefickt, bumsen, schwanz, titten, möse, fotze*, blasen, sex ab, sextreffen, sexkontakt*, stöhn*, orgasmus, wichsen, versaut*, in den mund, zwischen ihre, zwischen die beine, brüste, sexchat, besorgte es
porno*, nue, nues, nus, salope*, pute, putes, putain*, escortes, escorte, sexe dès, plan cul, baise, baisait, baiser, gémissait, gémit, suce*, suça, sucer, jouit, jouissait, orgasme, chatte, bite, queue dans, coquines, chaudes, webcam coquine, ses seins, entre ses cuisses, sexe gratuit, sexe à
porno*, desnuda*, desnudas, desnudo*, cachonda*, cachondo*, puta, putas, prostituta*, sexo desde, sexo gratis, sexo, follar*, follaba, follando, polla, coño, tetas, chupó, chupaba, mamada*, gemía, gimió, orgasmo, se corrió, correrse, calientes, escorts, entre sus piernas
裸聊, 约炮, 色情, 无码, 做爱, 一丝不挂, 呻吟, 乳房, 高潮, 裸照, 裸体, 赤裸, 援交, 招嫖, 卖淫, 嫖, 性交, 口交, 黄片, 成人视频, 激情视频, 插入她, 脱光, 舔
"""
SECOND_PERSON = "you, your, yours, yourself, you're, you'll, u, ur, du, dich, dir, dein, deine, deinen, deinem, deiner, ihr, euch, euer, eure, tu, toi, te, t', ton, ta, tes, vous, votre, vos, tú, ti, tuyo, tus, vosotros, os, sois, eres, usted, ustedes, vuestro, vuestra, 你, 你们, 您"
GROUP = "people, folk, those, them, they, all, every, immigrants, migrants, foreigners, refugees, women, men, religion, faith, race, leute, alle, ausländer, zugewanderte, zugewanderten, migranten, frauen, gens, étrangers, immigrés, migrants, tous, femmes, gente, todos, extranjeros, inmigrantes, mujeres, 人, 外来户, 移民, 外国人, 女人"
TECHNICAL = "file, valve, valves, wire, drawer, bolt, nut, thread, rod, form, field, store, warehouse, cleaning, door, mooring, bollard, inspection, draht, gewinde, muttergewinde, bolzen, schublade, lager, tür, reinigung, feile, hahn, amarrage, contrôle, fil, entrepôt, nettoyage, vanne, perno, pieza, almacén, limpieza, alambre, válvula, cable, campo, formulario, 仓库, 保洁, 防治, 阀, 螺母, 字段, 表单, 电线, process, processes, processus, thread, daemon, child process, parent process, service, server, script, signal, port, task, job, queue, node, cable, screw, socket, command, kill -9, sigkill, master, slave, plug, jack, male, female, connector, prozess, prozesse, kindprozess, dienst, befehl, aufgabe, schraube, stecker, buchse, fils, prise, tâche, commande, vis, proceso, procesos, hijo, tarea, comando, tornillo, enchufe, conector, 进程, 子进程, 线程, 服务, 任务, 命令, 插头, 接口, 螺丝, bug, bugs, pest control, parasitic capacitance, parasitic, capacitance, dump, core dump, abort, execute, execution, terminate"
MEDICAL = "patient, patients, doctor, clinic, cancer, exam, examination, screening, tumour, tumor, tissue, therapy, treatment, medical, medicine, hospital, infection, diagnosis, surgery, health, nurse, patientin, arzt, ärztin, klinik, krebs, untersuchung, vorsorge, gewebe, behandlung, krankenhaus, patiente, médecin, clinique, dépistage, examen, tissu, traitement, hôpital, cáncer, paciente, médico, clínica, tejido, tratamiento, cribado, 患者, 医生, 医院, 癌, 检查, 筛查, 治疗, 诊断, 感染"
RULES = "policy, rule, rules, code of conduct, conduct, forbidden, prohibited, not allowed, not permitted, must not, may not, report, reported, moderator*, moderation, harassment, warning, banned, removed, guidelines, complaint, quoted, zero tolerance, is not tolerated, will be removed, regel, regeln, verhaltensregeln, verboten, untersagt, nicht erlaubt, gemeldet, beleidigung*, belästigung, verwarnung, gesperrt, règle, règles, règlement, interdit*, interdite*, signaler, signalé, harcèlement, insultes, propos, modération, regla, reglas, normas, prohibido*, prohibida*, denunciar, acoso, insultos, moderador*, 规定, 规则, 守则, 禁止, 不得, 举报, 骚扰, 辱骂, 违规, 处罚"
