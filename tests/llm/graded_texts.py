"""Graded sentences, written for this library, from which the reading-level ranker learns.

Levels: 1 talk with small children, 2 everyday talk, 3 news, 4 demanding but general prose, 5 learned prose at university.
"""

GRADED = {
    1: [
        "The cat sat on the big red mat.", "I see a dog and a fish.", "We run and jump in the sun.", "Can you find my blue ball?", "The duck is in the pond.",
        "Mum has a new hat.", "Look, the moon is up!", "I like to eat jam.", "My sock is wet.", "The bear went to bed.", "Do not pull the tail.", "He has six toy cars and then we play a game.",
    ],
    2: [
        "I told you I would call after work, didn't I?", "Your sister left her bag in the kitchen again.", "We could go to the cinema on Saturday if you like.", "Nobody knows where he put the money.", "I'm sorry, I can't talk right now.",
        "She said the train was late because of the snow.", "What are you doing tonight?", "If you want some more coffee, it's on the table.", "My brother bought an old car and it broke down twice.", "Don't worry, everything will be fine tomorrow.",
        "I thought they were moving to another town.", "You should have asked your father before you took it.", "Call an ambulance, her pulse is weak and the fever is rising.", "The anaesthetist says he needs another transfusion.",
    ],
    3: [
        "Police officers searched the building on Tuesday after neighbours reported a fire.", "The mayor announced that the city would spend more money on public transport next year.", "According to the report, thousands of workers lost their jobs during the winter.",
        "The government rejected the plan although several members of parliament supported it.", "Heavy rain caused flooding in the eastern part of the region, and many roads remain closed.", "The company said on Monday that the chairman would resign before the annual meeting.",
        "A spokeswoman confirmed that the negotiations had ended without an agreement.", "The court will announce its decision before the election campaign begins.", "Scientists warned residents that the volcano could become active again.", "The opposition demanded an independent investigation after the documents were published.",
        "Prices increased by four percent while wages remained unchanged.", "The airline cancelled most international flights because of the strike.", "The detective questioned the director of the museum and two employees.",
    ],
    4: [
        "Although the novel was dismissed by early reviewers, its portrait of provincial life gradually found an enthusiastic readership.", "Gardeners have long known that certain plants grow better together, and recent experiments suggest why.",
        "The history of the harbour is largely the history of the families who controlled its warehouses.", "A good argument depends less on volume than on the careful selection of evidence.", "Engineers had to decide whether the old bridge could be strengthened or should be replaced altogether.",
        "What seems at first a simple question of taste soon becomes a matter of education and income.", "The documentary follows several musicians who abandoned comfortable careers for an uncertain life on the road.", "Many households could reduce their consumption considerably without noticing any loss of comfort.",
    ],
    5: [
        "The empirical evidence adduced in support of this hypothesis remains inconclusive, insofar as the underlying assumptions have not been subjected to independent verification.",
        "Notwithstanding these methodological reservations, the correlation between institutional complexity and administrative discretion appears to be statistically robust.",
        "The interpretation of constitutional provisions presupposes a normative conception of legitimacy that cannot itself be derived from positive legislation.",
        "Subsequent investigations demonstrated that the catalytic properties of the enzyme are contingent upon the conformational stability of its regulatory subunit.",
        "It has been argued that the epistemological status of theoretical entities is determined by the explanatory function which they perform within a given conceptual framework.",
        "The proliferation of heterogeneous regulatory regimes has substantially attenuated the comparability of longitudinal observations across jurisdictions.",
        "Whereas classical formulations treated equilibrium as an asymptotic property, contemporary scholarship emphasizes its dependence on historically specific configurations.",
        "The contractual obligation was held to be unenforceable, the plaintiff having failed to establish that the representation was either fraudulent or negligent.",
        "Provided that the distribution of residuals is approximately symmetrical, the estimator is consistent even where the variance of the disturbances is unknown.",
        "Neither the sedimentary record nor the isotopic composition of the samples permits an unequivocal reconstruction of prehistoric precipitation.",
        "Phenomenological approaches conceptualize intentionality as constitutive of experience rather than as a psychological mechanism superimposed upon it.",
        "The monetary transmission mechanism is attenuated to the extent that financial intermediaries anticipate accommodative intervention.",
        "Patients exhibiting immunological complications were excluded, since the therapeutic intervention could not be evaluated independently of concomitant medication.",
    ],
}
