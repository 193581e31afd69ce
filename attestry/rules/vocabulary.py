"""Controlled vocabularies. Names, patterns and masks must stay as they are for right results."""

ATTRIBUTES = {
    "Modality": {"images": [r"\bimages?\b", r"\bvisual\b"], "text": [r"\btexts?\b", r"\btextual\b"], "audio": [r"\baudio\b", r"\bspeech\b"], "video": [r"\bvideos?\b"], "tabular": [r"\btabular\b", r"\btable\s+data\b"]},
    "Task": {"summarization": [r"\bsummari[sz]ation\b", r"\bsummari[sz]e\b"], "translation": [r"\btranslation\b", r"\btranslate\b"], "classification": [r"\bclassification\b", r"\bclassify\b"], "segmentation": [r"\bsegmentation\b", r"\bsegment\b"], "retrieval": [r"\bretrieval\b", r"\bretrieve\b"]},
    "Split": {"train": [r"\btrain(?:ing)?\s+set\b", r"\btrain(?:ing)?\s+split\b"], "validation": [r"\bvalidation\s+set\b", r"\bvalidation\s+split\b", r"\bdev\s+set\b"], "test": [r"\btest\s+set\b", r"\btest\s+split\b"]},
    "Language": {x: [rf"\b{x}\b"] for x in ("English", "German", "French", "Spanish", "Chinese")},
    "Optimizer": {"AdamW": [r"\bAdamW\b"], "Adam": [r"\bAdam\b"], "SGD": [r"\bSGD\b", r"\bstochastic gradient descent\b"], "RMSProp": [r"\bRMSProp\b"]},
    "Availability": {"public": [r"\bpublicly\s+available\b", r"\bopen\s+source\b", r"\bopen\s+(?:model\s+)?weights?\b"], "private": [r"\bnot(?:\s+\w+){0,3}\s+publicly\s+available\b", r"\bclosed\s+(?:model\s+)?weights?\b", r"\bunavailable\b", r"\bprivate\b", r"\bproprietary\b"]},
    "Supervision": {"supervised": [r"\bsupervised\b", r"\blabeled\s+(?:data|examples|labels)\b"], "unsupervised": [r"\bunsupervised\b", r"\bwithout\s+labels\b"]},
    "Study design": {"randomized": [r"\brandomi[sz]ed\b", r"\brandomi[sz]ed\s+controlled\b"], "observational": [r"\bobservational\b", r"\bnot\s+randomi[sz]ed\b"]},
    "Summarization style": {"abstractive": [r"\babstractive\b"], "extractive": [r"\bextractive\b"]},
    "Agent setting": {"single-agent": [r"\bsingle[- ]agent\b"], "multi-agent": [r"\bmulti[- ]agent\b"]},
}
ATTRIBUTE_MASK = r"\b(abstractive|adamw?|audio|available|chinese|classification|classify|closed|dev|english|extractive|french|german|gradient|images?|labeled|labels|multi-agent|not|observational|open|optimization|private|proprietary|publicly|randomi[sz]ed|retrieval|retrieve|rmsprop|segmentation|segment|sgd|single-agent|source|spanish|speech|stochastic|summari[sz]ation|summari[sz]e|supervised|tabular|tables?|test|text|texts?|textual|train(?:ing)?|translate|translation|unsupervised|validation|videos?|visual)\b"

TECHNICAL = {
    "Complexity": {"constant": [r"\bconstant\s+time\b", r"\bo\s*\(\s*1\s*\)"], "logarithmic": [r"\blogarithmic\b", r"\bo\s*\(\s*log\s*n\s*\)"], "linear": [r"\blinear\s+(?:time|complexity)\b", r"\bo\s*\(\s*n\s*\)"], "quadratic": [r"\bquadratic\s+(?:time|complexity)\b", r"\bo\s*\(\s*n\s*\^?\s*2\s*\)"], "cubic": [r"\bcubic\s+(?:time|complexity)\b", r"\bo\s*\(\s*n\s*\^?\s*3\s*\)"], "exponential": [r"\bexponential\s+(?:time|complexity)\b", r"\bo\s*\(\s*2\^n\s*\)"]},
    "Inference fidelity": {"exact": [r"\bexact\s+(?:attention|algorithm|computation|inference|method)\b"], "approximate": [r"\bapproximate\s+(?:attention|algorithm|computation|inference|method)\b", r"\bapproximation\b"]},
    "Memory representation": {"symbolic knowledge graph": [r"\bsymbolic\s+knowledge\s+graph\b", r"\bknowledge\s+graph\b"], "dense vector index": [r"\bdense\s+(?:vector\s+)?index\b", r"\bvector\s+index\b"]},
    "Trainability": {"frozen": [r"\bfrozen\b", r"\bkept\s+fixed\b"], "fine-tuned": [r"\bfine[- ]tuned\b", r"\bfine[- ]tuning\b"]},
    "Reward density": {"dense": [r"\bdense\s+rewards?\b"], "sparse": [r"\bsparse\s+rewards?\b"]},
    "Evaluation domain": {"in-domain": [r"\bin[- ]domain\b"], "out-of-domain": [r"\bout[- ]of[- ]domain\b"]},
    "Data sensitivity": {"private": [r"\bprivate\s+(?:medical\s+)?records?\b", r"\bprivate\s+data\b"], "public": [r"\bpublic\s+(?:medical\s+)?records?\b", r"\bpublic\s+data\b"]},
    "Data origin": {"synthetic": [r"\bsynthetic\s+(?:clinical\s+)?(?:data|dialogues?|images?|interactions?|queries|records?)\b", r"\bsynthetic\s+user\s+(?:dialogues?|interactions?|queries)\b", r"\bsimulated\s+(?:user\s+)?(?:data|dialogues?|images?|interactions?|queries|records?)\b"], "real": [r"\breal\s+(?:clinical\s+)?(?:data|dialogues?|images?|interactions?|queries|records?)\b", r"\breal\s+user\s+(?:dialogues?|interactions?|queries)\b", r"\breal\s+patient\s+records?\b"]},
    "Trainable scope": {"all model weights": [r"\ball\s+(?:model\s+)?weights\b", r"\ball\s+parameters\b"], "adapter weights": [r"\badapter\s+weights\b", r"\blow[- ]rank\s+adapter\s+weights\b"], "frozen base weights": [r"\b(?:base|model|pretrained)\s+weights\s+(?:are\s+)?frozen\b", r"\bkeeps?\s+(?:base|model|pretrained)\s+weights\s+frozen\b"]},
    "Architecture family": {"dense transformer": [r"\bdense\s+transformer\b"], "mixture-of-experts": [r"\bmixture[- ]of[- ]experts\b", r"\bmoe\b"]},
    "Pretraining objective": {"causal language modeling": [r"\bcausal\s+language\s+model(?:ing)?\b", r"\bclm\b"], "masked language modeling": [r"\bmasked\s+language\s+model(?:ing)?\b", r"\bmlm\b"], "replaced-token detection": [r"\breplaced[- ]token\s+detection\b", r"\brtd\b"]},
    "Evaluation setting": {f"{n}-shot": [rf"\b{n}[- ]shot\b"] for n in ("zero", "one", "few")},
    "Decoding strategy": {"greedy search": [r"\bgreedy\s+(?:search|decoding)\b"], "beam search": [r"\bbeam\s+(?:search|decoding)\b"], "sampling": [r"\bsampling\b", r"\bsample[- ]based\s+decoding\b"]},
}
TECHNICAL_MASK = r"\b(adapter|all|approximate|approximation|architecture|attention|base|beam|causal|clinical|clm|constant|cubic|data|decod(?:e|es|ed|ing)|dense|detection|domain|exact|experts?|exponential|few|fine|fixed|frozen|graph|greedy|index|inference|keeps?|kept|knowledge|language|linear|logarithmic|low|masked|medical|memory|mlm|model|modeling|moe|objective|one|out|parameters|pretrained|private|public|quadratic|rank|records?|replaced|rewards?|real|rtd|sampling|search|shot|simulated|sparse|synthetic|time|token|transformer|tuned|tuning|user|vector|weights?|zero)\b"
SUBJECTS = ["algorithm", "architecture", "attention", "classifier", "index", "memory", "method", "model", "retrieval", "system", "training"]

STATISTICS = {
    "Confidence interval": {"includes zero": [r"\bincludes?\s+zero\b"], "excludes zero": [r"\bexcludes?\s+zero\b"]},
    "F1 averaging": {"macro-F1": [r"\bmacro[- ]?f1\b"], "micro-F1": [r"\bmicro[- ]?f1\b"]},
    "AUROC averaging": {"macro-AUROC": [r"\bmacro[- ]?(?:auroc|auc)\b"], "micro-AUROC": [r"\bmicro[- ]?(?:auroc|auc)\b"]},
    "Summary statistic": {"mean": [r"\bmean\b"], "median": [r"\bmedian\b"]},
    "Uncertainty statistic": {"standard deviation": [r"\bstandard\s+deviation\b"], "standard error": [r"\bstandard\s+error\b"]},
    "Pairedness": {"paired": [r"\bpaired\b"], "unpaired": [r"\bunpaired\b"]},
    "Tail count": {"one-tailed": [r"\bone[- ]tailed\b"], "two-tailed": [r"\btwo[- ]tailed\b"]},
    "Test family": {"parametric": [r"\bparametric\b"], "nonparametric": [r"\bnon[- ]?parametric\b"]},
}
STATISTICS_MASK = r"\b(excludes?|includes?|macro[- ]?(?:auroc|auc|f1)|mean|median|micro[- ]?(?:auroc|auc|f1)|non[- ]?parametric|one[- ]tailed|paired|parametric|standard\s+deviation|standard\s+error|p[- ]?value|p|significant|statistically|two[- ]tailed|unpaired|zero)\b"
STATISTICS_STOPWORDS = ["an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "has", "not", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "with"]

PROTOCOLS = {
    "Correction method": {"Bonferroni": [r"\bbonferroni\b"], "Benjamini-Hochberg": [r"\bbenjamini[- ]hochberg\b", r"\bfdr\b"], "Holm": [r"\bholm\b"]},
    "Blinding": {"blinded": [r"\bblinded\b", r"\bmasked\b"], "unblinded": [r"\bunblinded\b", r"\bnot\s+blinded\b", r"\bopen[- ]label\b"]},
    "Study temporality": {"prospective": [r"\bprospective\b"], "retrospective": [r"\bretrospective\b"]},
    "Architecture": {"encoder-only": [r"\bencoder[- ]only\b"], "decoder-only": [r"\bdecoder[- ]only\b"], "encoder-decoder": [r"\bencoder[- ]decoder\b", r"\bseq2seq\b"]},
    "Train-test relation": {"disjoint": [r"\bdisjoint\b", r"\bheld[- ]out\b", r"\bno\s+overlap\b"], "overlapping": [r"\bsame\s+(?:patients?|examples?|samples?)\b", r"\boverlap(?:ping)?\b"]},
    "Duplicate preprocessing": {"removes duplicates": [r"\bremov(?:e|es|ed)\s+duplicate", r"\bdeduplicat(?:e|es|ed)"], "retains duplicates": [r"\bretain(?:s|ed)?\s+duplicate", r"\bkeep(?:s|ing)?\s+duplicate"]},
    "Commercial availability": {"commercial use": [r"\bcommercial\s+use\b", r"\bcommercially\s+usable\b"], "non-commercial only": [r"\bnon[- ]commercial\b", r"\bresearch\s+use\s+only\b"]},
    "Correlation sign": {"positive": [r"\bpositively\s+correlated\b", r"\bpositive\s+correlation\b"], "negative": [r"\bnegatively\s+correlated\b", r"\bnegative\s+correlation\b"]},
    "Comparator/control": {"placebo": [r"\bplacebo(?:\s+control(?:\s+group)?)?\b"], "usual care": [r"\busual\s+care\b", r"\bstandard\s+care\b", r"\btreatment\s+as\s+usual\b"], "active control": [r"\bactive\s+control(?:\s+group)?\b"], "sham": [r"\bsham(?:\s+control)?\b"], "waitlist": [r"\bwait[- ]list(?:\s+control)?\b"]},
    "Dosing frequency": {"twice daily": [r"\btwice\s+daily\b", r"\btwo\s+times\s+(?:per|a)\s+day\b", r"\bbid\b"], "daily": [r"\bdaily\b", r"\bonce\s+daily\b", r"\bevery\s+day\b", r"\bqd\b"], "weekly": [r"\bweekly\b", r"\bonce\s+a\s+week\b", r"\bevery\s+week\b"], "monthly": [r"\bmonthly\b", r"\bonce\s+a\s+month\b", r"\bevery\s+month\b"]},
}
TARGETS = {
    "Endpoint": {"primary endpoint": [r"\bprimary\s+endpoint\b"], "secondary endpoint": [r"\bsecondary\s+endpoint\b"]},
    "Evaluation target": {"calibration": [r"\bcalibration\b"], "discrimination": [r"\bdiscrimination\b"]},
}
PROTOCOL_MASK = r"\b(benjamini[- ]hochberg|blinded|bonferroni|calibration|commercial|decoder[- ]only|active|bid|control|daily|deduplicat(?:e|es|ed)|discrimination|disjoint|encoder[- ]decoder|encoder[- ]only|every|fdr|held[- ]out|holm|masked|monthly|negative|non[- ]commercial|once|open[- ]label|overlap(?:ping)?|placebo|positive|primary|prospective|qd|remov(?:e|es|ed)|research|retain(?:s|ed)?|retrospective|secondary|seq2seq|sham|standard|twice|unblinded|usual|wait[- ]list|weekly)\b"
RELEASED = r"\breleas(?:e|es|ed|ing)\s+(?:open[- ]source\s+)?training\s+code\b"
NOT_RELEASED = r"\b(?:do|does|did)\s+not\s+release\s+training\s+code\b|\btraining\s+code\s+(?:is|was|were|remains?|remained)?\s*(?:not\s+released|private)\b"

#: (group, value that wins, value that it drops, pattern that it takes besides)
OVERRIDES = [("Availability", "private", "public", None), ("Study design", "observational", "randomized", r"\bnot\s+randomi[sz]ed\b"), ("Test family", "nonparametric", "parametric", None), ("Commercial availability", "non-commercial only", "commercial use", None), ("Blinding", "unblinded", "blinded", None), ("Dosing frequency", "twice daily", "daily", None), ("Trial design", "single-arm", "controlled", None)]

OUTCOMES = {"accuracy": [r"\baccuracy\b"], "BLEU": [r"\bbleu\b"], "calibration": [r"\bcalibration\b"], "chrF": [r"\bchrf\b"], "discrimination": [r"\bdiscrimination\b"], "factuality": [r"\bfactuality\b"], "hallucinations": [r"\bhallucinations?\b"], "latency": [r"\blatency\b"], "loss": [r"\bloss\b"], "mean absolute error": [r"\bmean\s+absolute\s+error\b", r"\bmae\b"], "mortality": [r"\bmortality\b"], "perplexity": [r"\bperplexity\b"], "readmissions": [r"\breadmissions?\b"]}
LOWER_IS_BETTER = ["hallucinations", "latency", "mean absolute error", "loss", "perplexity", "mortality", "readmissions"]
OUTCOME_RESULT = r"\b(improves?|improved|reduces?|reduced|decreases?|decreased|lowers?|lowered)\b"
IMPROVE = r"\b(improves?|improved|increases?|increased|higher|better)\b"
WORSEN = r"\b(worsens?|worse|reduces?|reduced|decreases?|decreased|lowers?|lowered)\b"
HIGHER = r"\b(higher|increased|larger|greater)\b"
MIXED = r"\b(but|whereas|while|although|however)\b"
OUTCOME_MASK = r"\b(accuracy|bleu|calibration|chrf|decreas(?:e|es|ed)|discrimination|factuality|greater|hallucinations?|higher|improv(?:e|es|ed)|increas(?:e|es|ed)|larger|latency|loss|lowers?|lowered|mae|mean\s+absolute\s+error|mortality|perplexity|readmissions?|reduc(?:e|es|ed)|unchanged|worse|worsens?)\b"

QUALITY_MASK = r"\b(all|among|both|convolutional|every|majority|many|most|multiple|no|not|of|offline|only|online|one|requires?|several|significant|significantly|some|state|statistically|subset|the|three|transformer|universally)\b"
NOT_SIGNIFICANT = r"\b(not\s+statistically\s+significant|not\s+significant|no\s+statistically\s+significant)\b"
SOTA = r"\b(?:achieves?|reaches?)\s+state[- ]of[- ]the[- ]art\b"
NOT_SOTA = r"\b(?:does\s+not|did\s+not|not)\s+(?:achieve|reach)\s+state[- ]of[- ]the[- ]art\b"
NOT_INDICATOR = r"\b(?:can\s+not|cannot|does\s+not|is\s+not|not)\s+(?:be\s+)?(?:a\s+)?good\s+indicator\b"
INTRACTABLE = r"\bintractable\b|\b(?:must|need(?:s)?)\s+(?:be\s+)?used?\b.{0,60}\bapproximation\b|\bapproximation\b.{0,60}\b(?:must|need(?:s)?)\s+(?:be\s+)?used?\b"
INSUFFICIENT = r"\b(?:does\s+not|did\s+not|doesn't|didn't)\s+work\b|\bnot\s+(?:guaranteed|sufficient)\b"
OBJECT = r"([A-Za-z0-9][A-Za-z0-9 .-]{1,60})"
LONG_OBJECT = r"([A-Za-z0-9][A-Za-z0-9 .-]{1,80})"
REQUIRED_STOP = r"\b(?:for|during|with|and|or|but|while|whereas|when)\b"
ROLE_STOP = r"\b(?:and|but|while|whereas|with|during|for|from|than|using)\b"
NEGATION_STOP = r"\b(?:but|although|while|whereas|and|or|by|for|with|during|from|than|when)\b"
COMPONENT_STOP = r"\b(?:and|but|for|from|in|of|to|while|whereas|with)\b"
DESCRIPTORS = [("transformer", "convolutional"), ("offline", "online")]

COMPONENTS = ["retrieval", "reranking", "attention", "adapter", "pretraining"]
CONTEXT_RESULT = r"\b(generali[sz]es?|improves?|improved|reduces?|reduced|increases?|increased|outperforms?)\b"
CONTEXT_MASK = r"\b(ablation|adults?|case|children|ex|hardware|humans?|if|in|mice|mouse|only|oracle|patients?|pediatric|rats?|real|simulated|simulation|single|site|study|subset|under|vitro|when|with|without)\b"
LIMITERS = [
    r"\b(only\s+(?:when|if)|when|if|assuming|provided\s+that|under\s+oracle|with\s+oracle)\b",
    r"\bamong\s+[A-Za-z0-9 -]{1,80}\s+only\b",
    r"\b(?:\d+(?:\.\d+)?%|one\s+percent|small|limited)\s+(?:[A-Za-z0-9-]+\s+){0,2}subset\b|\bsubset\b|\b(?:one|single)\s+case\s+study\b|\bsingle[- ]site\b",
    r"\b(?:one|single)\s+case\s+study\b|\bcase\s+study\b",
    r"\bin\s+vitro\b|\bex\s+vivo\b",
]
SIMULATION, HARDWARE = r"\bsimulat(?:ed|ion)\b", r"\bhardware\b|\breal[- ](?:user|world)\b"
NOT_EVALUATED = r"\b(?:hardware|real[- ](?:user|world))\b.{0,60}\bnot\s+evaluated\b|\bnot\s+evaluated\b.{0,60}\b(?:hardware|real[- ](?:user|world))\b"
HUMAN, ANIMAL, CHILD = r"\bhumans?\b|\bpatients?\b|\badults?\b", r"\bmice\b|\bmouse\b|\brats?\b", r"\bchildren\b|\bpediatric\b"
CONTRAST = r"\b(?:rather\s+than|instead\s+of|as\s+opposed\s+to)\b"

ASSERTED = r"\b(improves?|improved|reduces?|reduced|outperforms?|shows?|demonstrates?)\b"
PLANNED = r"(?:future\s+work|hypothesi[sz]e[sd]?|hypothesis|designed\s+to|intended\s+to|aims?\s+to|will\s+test|proposed\s+to)"
CONFIRMED = r"\b(confirmed|validated|supported|verified|demonstrated)\b"
ASSERTION_MASK = r"\b(aims?|confirmed|designed|demonstrated|demonstrates?|future|hypothesi[sz]e[sd]?|hypothesis|improved|improves?|intended|outperforms?|proposed|reduced|reduces?|shows?|supported|test|validated|verified|will|work)\b"

MAGNITUDE = r"\s+(?:\w+\s+){0,3}(?:benefits?|decreases?|effects?|gains?|improvements?|increases?|reductions?)"
NO_OVERHEAD = r"no((?:\s+\w+){0,5})\s+overheads?"
SOME_OVERHEAD = r"(small|some|non[- ]?zero)((?:\s+\w+){0,5})\s+overheads?"
CAUSAL = r"(?:causes|caused|causal|causally|proves|demonstrates|leads?\s+to|led\s+to|results?\s+in|resulted\s+in|drives?|drove)"
ASSOCIATION = r"(?:associations?|associated|correlations?|correlated|suggests?|suggested|may|observational|cross[- ]sectional|retrospective|non[- ]?randomi[sz]ed)"
TOP_RANK, GOOD_RANK = r"(?:best|top[- ]performing|highest)", r"(?:competitive|comparable)"
COMPLETE, PARTIAL = r"(?:full|fully|complete|completely)", r"(?:partial|partially)"
RECOVERY = r"\b(recover(?:y|ies|s|ed)?|reconstruct(?:ion|s|ed)?|restor(?:ation|es|ed)?)\b"
STRENGTH_MASK = r"\b(associations?|associated|best|causal|causally|caused|causes|comparable|competitive|complete|completely|correlations?|correlated|cross|demonstrates|drives?|drove|full|fully|highest|large|led|leads?|may|modest|no|non|nonzero|observational|overheads?|partial|partially|proves|randomi[sz]ed|results?|resulted|retrospective|sectional|recover(?:y|ies|s|ed)?|reconstruct(?:ion|s|ed)?|restor(?:ation|es|ed)?|small|some|substantial|suggested|suggests?|top|performing|zero)\b"
CLAUSE_END = r"(?i)[.;:]+|,\s*(?=[A-Za-z0-9])|\b(?:and|but|whereas|while)\b"

UP, DOWN = r"\b(increase[sd]?|higher)\b", r"\b(decrease[sd]?|lower|reduced)\b"
LOWER_BOUND = r"\b(over|more\s+than|greater\s+than|at\s+least|no\s+less\s+than)\b"
UPPER_BOUND = r"\b(up\s+to|at\s+most|no\s+more\s+than|under|less\s+than)\b"
STRICT_LOWER, STRICT_UPPER = r"\b(over|more\s+than|greater\s+than)\b", r"\b(under|less\s+than)\b"
BOUND_MASK = r"\b(?:at\s+least|at\s+most|greater\s+than|less\s+than|more\s+than|no\s+less\s+than|no\s+more\s+than|up\s+to|over|under|exactly)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
HEDGE = r"\b(may|might|could|inconclusive|suggests|preliminary)\b"
UNIVERSAL, NARROW = r"\b(all|always|every|universally)\b", r"\b(only|some|subset|two|few|limited)\b"

RATIO = r"(?:hazard\s+ratio|odds\s+ratio|risk\s+ratio|relative\s+risk)"
P_VALUE = r"(?<![-A-Za-z])\bp(?:[- ]?value)?\s*(?:(<=|>=|<|>|=)|(less\s+than|below|under|greater\s+than|above|at\s+least|no\s+less\s+than|at\s+most|no\s+more\s+than|equal\s+to|equals?|is|was))?\s*(\d?\.\d+|\d+(?:\.\d+)?)"
P_RELATIONS = {"<": "lt", "less than": "lt", "below": "lt", "under": "lt", "<=": "le", "at most": "le", "no more than": "le", ">": "gt", "greater than": "gt", "above": "gt", ">=": "ge", "at least": "ge", "no less than": "ge"}
CI_RANGE = r"\b(?:\d+(?:\.\d+)?%\s+)?(?:confidence\s+interval|ci)\b[^()\[\]]{0,60}[\[(]\s*([+-]?\d+(?:\.\d+)?)\s*,\s*([+-]?\d+(?:\.\d+)?)\s*[\])]"
RATIO_CI = rf"\b{RATIO}\b[^;\n]{{0,100}}?\b(?:ci|confidence\s+interval)\b[^()\[\]]{{0,40}}[\[(]\s*([+-]?\d+(?:\.\d+)?)\s*,\s*([+-]?\d+(?:\.\d+)?)\s*[\])]"
RATIO_POINT = rf"\b({RATIO})\b([^.;\n]{{0,80}}?)\b(?:was|is|=|of)?\s*(\d+(?:\.\d+)?)\b"
RATIO_VALUE = rf"\b({RATIO})\b[^.;\n]{{0,40}}?\b(?:was|is|=|of)?\s*(\d+(?:\.\d+)?)\b"
ENDPOINT = r"\b(\d+(?:\.\d+)?)[-\s]+(days?|weeks?|months?|years?)[-\s]+(mortality|readmissions?|survival|response|remission)\b"
POPULATIONS = {"adult": [r"\badults?\b"], "child": [r"\bchildren\b", r"\bchild\b", r"\bpediatric\b", r"\bpaediatric\b"]}
TRIALS = {"randomized": [r"\brandomi[sz]ed\b", r"\brandomi[sz]ed\s+controlled\b"], "controlled": [r"\bcontrolled\b", r"\bcontrol\s+arm\b"], "single-arm": [r"\bsingle[- ]arm\b"]}
CLINICAL_MASK = r"\b(adjusted|adults?|children|child|controlled|crude|days?|hazard|mortality|odds|paediatric|patients?|pediatric|randomi[sz]ed|ratio|rats?|readmissions?|relative|remission|response|risk|single|survival|unadjusted|weeks?|months?|years?)\b"
METRIC = r"accuracy|auprc|auroc|auc|bleu|chrf|f1(?:\s+score)?|loss|perplexity|rouge(?:-\w+)?"
METRIC_MASK = rf"\b(?:{METRIC}|achieved|benchmark|evaluation|score|set|test|uses?)\b"
METRIC_BASES = ["AUC", "AUROC", "AUPRC", "BLEU", "CHRF", "F1", "ROUGE"]
CONFIG_NUMBER = r"\d+(?:\.\d+)?(?:e[-+]?\d+)?"
CONFIG_SLOTS = {"learning rate": r"(?:learning\s+rate|lr)", "batch size": r"batch\s+size", "epoch count": r"epochs?", "dropout": r"dropout(?:\s+rate)?", "temperature": r"temperature", "top-p": r"top[-\s]?p", "weight decay": r"weight\s+decay", "beam size": r"beam\s+size"}
CONFIG_MASK = rf"\b(batch|beam|decay|decoder|dropout|epoch|epochs|learning|lr|rate|temperature|top|p|trained|training|used|uses|weight)\b|{CONFIG_NUMBER}"
MAPPING = r"\b([A-Za-z][A-Za-z0-9_-]{0,20})\s*=\s*(-?\d+|[A-Za-z])\s+(?:means?|denotes?|indicates?|corresponds?\s+to)\s+(.+?)(?=,\s*(?:and\s+)?[A-Za-z][A-Za-z0-9_-]{0,20}\s*=|\s+and\s+[A-Za-z][A-Za-z0-9_-]{0,20}\s*=|[.;]|$)"
MEANING_STOP = ["a", "an", "and", "agent", "for", "immediately", "message", "next", "the", "to", "user", "will"]
MEANING_ALIASES = {"answers": "answer", "replies": "reply", "responds": "respond", "waiting": "wait", "waits": "wait"}

MATERIAL = r"\b(?:[A-Z]+[A-Za-z0-9.-]*\d+[A-Za-z0-9.-]*|[A-Z][A-Za-z]*[A-Z][A-Za-z0-9.]*|[A-Z][a-z]+[A-Z][A-Za-z0-9.]*|[A-Z]{2,}[A-Za-z0-9.-]*)\b"
MATERIAL_PHRASE = r"(?<!\b[A-Z][A-Za-z]{0,40}\s{1,3})\b[A-Z][a-z]+\s+(?:[Aa]dapter|[Aa]daptation|[Ff]ine-[Tt]uning|[Ll]earning|[Mm]ethod|[Mm]odel|[Nn]etwork|[Rr]eplay|[Rr]etrieval|[Tt]raining|[Tt]uning)\b"
GENERIC = ["Ablation", "Appendix", "Baseline", "Claim", "Dataset", "Evidence", "Experiment", "Figure", "IID", "Method", "MEANT", "Model", "NLG", "Result", "Table", "Task", "The", "YISI"]
RELATIONS = {"beats": "higher_is_better/generic", "outperforms": "higher_is_better/generic", "outperformed": "higher_is_better/generic", "exceeds": "higher_is_better/generic", "is better than": "higher_is_better/generic", "is superior to": "higher_is_better/generic", "has higher accuracy than": "higher_is_better/accuracy", "achieves higher accuracy than": "higher_is_better/accuracy", "has lower error than": "lower_is_better/error", "ties": "neutral/generic", "is tied with": "neutral/generic", "matches": "neutral/generic", "is comparable to": "neutral/generic"}
PLACEHOLDER = r"\b(?:Method|Model|System|Dataset|Benchmark)\s+[A-Z]\b"
EXEMPT_UNITS = ["example", "image", "mask", "record", "sample", "text"]
